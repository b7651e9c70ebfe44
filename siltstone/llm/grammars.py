"""Token rules and grammars of the languages whose files are checked.

Grammars describe syntax alone and are somewhat wider than the languages' definitions where only names,
types or the order of modifiers decide. Fixed values: keywords and operators of the languages.
"""

from __future__ import annotations

import re
from functools import lru_cache

from siltstone.llm.chart import Grammar

#: Extensions of the languages that have a grammar here; other languages are not judged.
EXTENSIONS = {".go": "go", ".py": "python", ".js": "javascript", ".ts": "typescript", ".java": "java", ".rs": "rust", ".json": "json", ".yaml": "yaml", ".yml": "yaml", ".sh": "shell", ".bash": "shell"}

BRACKETS = {"(": ")", "[": "]", "{": "}"}


GO = """
file :: top
top = 'package' ID end | 'import' ( spec | P:specs ) end | 'func' P:params? ID B:tparams? P:params result? C:block? end | decl end | ';'
end = ';'?
specs :: specline
specline = spec ';'? | ';'
spec = ( ID | '.' )? STR
decl = 'type' ( typespec | P:typespecs ) | ( 'var' | 'const' ) ( valspec | P:valspecs )
typespecs :: typeline
typeline = typespec ';'? | ';'
typespec = ID B:tparams? '='? type
valspecs :: valline
valline = valspec ';'? | ';'
valspec = ids type? ( '=' exprs )? | ids '=' exprs
ids = ID | ids ',' ID
params := param ','
param = type | '...' type | ID type | ID '...' type
tparams := tparam ','
tparam = ID constraint | ID
constraint = ( '~'? type ) | constraint '|' '~'? type
result = type | P:params
type = '*' type | name B:types? | B:length type | 'map' B:types type | 'chan' '<-'? type | '<-' 'chan' type | 'func' P:params result? | 'struct' C:fields | 'interface' C:methods | P:types
name = ID | ID '.' ID
types := type ','
length = ( expr | '...' )?
fields :: field
field = ids type STR? ';'? | '*'? name B:types? STR? ';'? | ';'
methods :: method
method = ID P:params result? ';'? | constraint ';'? | ';'
block :: stmt
stmt = simple? ';' | simple | 'return' exprs? end | flow end | control end | decl end | ID ':' stmt? | C:block end
flow = ( 'break' | 'continue' ) ID? | 'goto' ID | 'fallthrough' | ( 'go' | 'defer' ) expr
control = if | 'for' ( expr | simple? ';' expr? ';' simple? | ( exprs ( '=' | ':=' ) )? 'range' expr )? C:block | 'switch' ( simple? ';' )? ( simple )? C:cases | 'select' C:cases
if = 'if' ( simple? ';' )? expr C:block ( 'else' ( if | C:block ) )?
cases :: case
case = label+ stmt? | stmt
label = 'case' ( types1 | simple ) ':' | 'default' ':'
types1 = exprs
simple = exprs | exprs ASSIGN exprs | exprs ':=' exprs | exprs '=' exprs | exprs ':=' expr '.' P:typeword | expr INC | expr '<-' expr
exprs = expr | exprs ',' expr
expr = unary | expr ( OP | SIGN | '*' | '&' | '|' | '<-' | '<' | '>' ) unary
unary = ( OP1 | SIGN | '*' | '&' | '<-' | '~' ) unary | primary
primary = operand | primary '.' ID | primary '.' P:typeword | primary P:args | primary B:index | primary C:literal
operand = ID | NUM | STR | P:one | 'func' P:params result? C:block | littype C:literal | convtype P:args
littype = B:length type | 'map' B:types type | 'struct' C:fields
convtype = B:length type | 'chan' type | 'interface' C:methods | 'map' B:types type | '*' type
typeword = 'type' | type
one = expr | type
args := arg ','
arg = expr '...'? | type
index = expr | expr? ':' expr? ( ':' expr )? | types2
types2 = type ( ',' type )*
literal := element ','
element = ( item ':' )? item
item = expr | C:literal
"""

#: Shared by JavaScript and TypeScript; the type parts are empty in JavaScript.
SCRIPT = """
file :: top
top = 'import' ( STR | imported 'from' STR ) with? end | 'import' P:args tail? end | 'import' '.' ID tail? end | 'export' ( decl | 'default' ( fn | class | expr end ) | C:names ( 'from' STR )? end | '*' ( 'as' ID )? 'from' STR end | TYPEX ) | stmt
with = ( 'with' | 'assert' ) C:object
imported = TYPEW? ( ID | C:names | '*' 'as' ID | ID ',' C:names | ID ',' '*' 'as' ID )
names := named ','
named = TYPEW? word ( 'as' word )?
word = ID | STR | KEY | 'as' | 'from' | 'of' | 'get' | 'set' | 'static' | 'async' | 'type' | 'default' | 'import' | 'function' | 'class' | 'new' | 'typeof' | 'void' | 'this' | 'in' | 'for' | 'if' | 'return' | 'const' | 'let' | 'var' | 'case' | 'catch' | 'delete' | 'export' | 'extends' | 'finally' | 'switch' | 'throw' | 'try' | 'while' | 'with' | 'do' | 'else' | 'break' | 'continue' | 'await' | 'yield' | 'interface' | 'enum' | 'namespace' | 'declare' | 'abstract' | 'readonly' | 'keyof' | 'infer' | 'is' | 'implements' | 'super' | 'instanceof' | 'debugger' | 'public' | 'private' | 'protected' | 'satisfies' | 'assert' | 'module'
id = ID | 'as' | 'from' | 'of' | 'get' | 'set' | 'async' | 'type' | 'namespace' | 'declare' | 'abstract' | 'readonly' | 'keyof' | 'infer' | 'is' | 'static' | 'satisfies' | 'assert' | 'module'
end = ';'?
decl = vars end | fn | class | TYPED
vars = ( 'const' | 'let' | 'var' ) bindings
bindings = binding | bindings ',' binding
binding = target ANN ( '=' expr1 )?
target = id | C:pattern | B:elements
pattern := property ','
property = '...' id | key ':' target ( '=' expr1 )? | id ( '=' expr1 )?
elements := hole ','
hole = ( '...'? target ( '=' expr1 )? )?
fn = 'async'? 'function' '*'? id? GENERIC P:params RETURNS C:block
params := param ','
param = DECO* MODIFIER '...'? target OPTIONAL ANN ( '=' expr1 )? | 'this' ANN
class = DECO* CLASSMOD 'class' id? GENERIC ( 'extends' left TARGS )? IMPLEMENTS C:members
members :: member
member = ';' | 'static' C:block | DECO* MEMBERMOD ( 'static' | 'async' | 'get' | 'set' | '*' )* MEMBERMOD key OPTIONAL ( GENERIC P:params RETURNS ( C:block | SIGNATURE ) | ANN ( '=' expr )? end ) | INDEXSIG
key = word | NUM | B:expr1 | '#' ID
block :: stmt
stmt = decl | expr end | ';' | C:block | 'if' P:expr stmt ( 'else' stmt )? | 'for' 'await'? P:forhead stmt | 'while' P:expr stmt | 'do' stmt 'while' P:expr end | ( 'break' | 'continue' ) id? end | 'return' expr? end | 'throw' expr end | 'try' C:block ( 'catch' P:caught? C:block )? ( 'finally' C:block )? | 'switch' P:expr C:cases | id ':' stmt | 'debugger' end
caught = target ANN
forhead = ( vars | expr )? ';' expr? ';' expr? | ( 'const' | 'let' | 'var' )? target ( 'of' | 'in' ) expr | left ( 'of' | 'in' ) expr
cases :: case
case = casing+ stmt? | stmt
casing = 'case' expr ':' | 'default' ':'
expr = expr1 | expr ',' expr1
expr1 = arrow | 'yield' '*'? expr1? | goal ( ASSIGN | '=' ) expr1 | cond
goal = id | left '.' word | left '.' '#' ID | left B:expr | P:expr | B:array | C:object | NONNULL
arrow = 'async'? ( id | GENERIC P:params RETURNS ) '=>' ( C:block | expr1 )
cond = binary | binary '?' expr1 ':' expr1
binary = unary | binary binop unary | binary CAST
binop = OP | SIGN | '&' | '|' | '*' | '<' | '>' | '>' '>' | '>' '>' '>' | '>' '=' | 'in' | 'instanceof'
unary = ( OP1 | SIGN | '!' | 'typeof' | 'void' | 'delete' | 'await' | INC ) unary | left INC?
left = primary | left '.' word | left '.' '#' ID | left '?.' ( word | B:expr | P:args ) | left B:expr | left TARGS P:args | left STR | left TPL S:expr+ | NONNULL
primary = id | NUM | STR | TPL S:expr+ | REGEX | 'this' | 'super' | P:expr | B:array | C:object | fn | class | 'new' ( '.' ID | newee TARGS P:args? ) | 'import' ( P:args | '.' ID ) | '#' ID
newee = id | newee '.' word | newee B:expr | P:expr | 'this' | 'new' newee P:args? | fn | class | 'import' '.' ID
tail = '.' word | tail '.' word | tail P:args | tail B:expr
args := arg ','
arg = '...'? expr1
array := slot ','
slot = ( '...'? expr1 )?
object := entry ','
entry = '...' expr1 | key ':' expr1 | id ( '=' expr1 )? | ( 'async' | 'get' | 'set' | '*' )* key GENERIC P:params RETURNS C:block
"""

NO_TYPES = """
ANN =
RETURNS =
GENERIC =
TARGS =
OPTIONAL =
MODIFIER =
MEMBERMOD =
CLASSMOD =
IMPLEMENTS =
"""

TYPES = """
ANN = ( '!'? ':' type )?
RETURNS = ( ':' ( type | 'asserts'? ( id | 'this' ) 'is' type | 'asserts' id ) )?
GENERIC = ( '<' generics '>' )?
generics = generic ( ',' generic )* ','?
generic = 'const'? 'in'? id ( 'extends' type )? ( '=' type )?
TARGS = ( '<' typelist '>' )?
typelist = type ( ',' type )*
OPTIONAL = '?'?
MODIFIER = ( 'public' | 'private' | 'protected' | 'readonly' | 'override' )*
MEMBERMOD = ( 'public' | 'private' | 'protected' | 'readonly' | 'override' | 'abstract' | 'declare' )*
CLASSMOD = 'abstract'?
IMPLEMENTS = ( 'implements' typelist )?
SIGNATURE = ';'?
INDEXSIG = 'static'? 'readonly'? B:indexer ANN end
indexer = id ':' type
TYPEW = 'type'
TYPEX = 'type' C:names ( 'from' STR )? end | '=' expr end | 'import' id '=' expr end
TYPED = 'type' id GENERIC '=' type end | 'interface' id GENERIC ( 'extends' typelist )? C:shape | 'const'? 'enum' id C:enums | ( 'namespace' | 'module' ) ( name | STR ) C:file | 'declare' ( decl | ( 'module' | 'namespace' ) ( name | STR ) C:file | 'global' C:file )
enums := enum ','
enum = ( word | B:expr1 ) ( '=' expr1 )?
CAST = ( 'as' | 'satisfies' ) ( type | 'const' )
NONNULL = left '!'
name = id ( '.' word )*
type = conditional | 'new'? GENERIC P:params '=>' ( type | 'asserts'? id 'is' type ) | 'abstract' 'new' P:params '=>' type
conditional = union | union 'extends' union '?' type ':' type
union = '|'? inter | union '|' inter | '&' inter
inter = tprefix | inter '&' tprefix
tprefix = ( 'keyof' | 'readonly' | 'unique' | 'infer' ) tprefix | postfix
postfix = tatom | postfix B:index
index = type?
tatom = 'import' P:args ( '.' word )* TARGS | name TARGS | 'void' | 'this' | STR | TPL S:type+ | NUM | SIGN NUM | 'typeof' left TARGS | P:type | B:tuple | C:shape | C:mapped | KEY
tuple := titem ','
titem = '...'? ( id '?'? ':' )? type '?'?
mapped = ( SIGN? 'readonly' )? B:mapkey ( SIGN? '?' )? ANN ';'?
mapkey = id 'in' type ( 'as' type )?
shape :: shaped
shaped = ( 'readonly' | 'get' | 'set' )* key OPTIONAL ( GENERIC P:params RETURNS | ANN ) sepa | 'new'? GENERIC P:params RETURNS sepa | 'readonly'? B:indexer ANN sepa | ';' | ','
sepa = ( ';' | ',' )?
"""

JAVA = """
file :: top
top = anno* 'package' name ';' | 'import' 'static'? name ( '.' '*' )? ';' | typedecl | ';' | 'open'? 'module' name C:directives
directives :: directive
directive = id+ ( '.' id )* ( ',' name )* ';'
name = id | name '.' id
id = ID | 'record' | 'sealed' | 'permits' | 'var' | 'yield' | 'non' | 'module' | 'open' | 'when'
mods = ( anno | MOD | 'static' | 'default' | 'sealed' | 'non' SIGN 'sealed' | 'synchronized' | 'final' )*
anno = '@' name P:annoargs?
annoargs := annoarg ','
annoarg = ( id '=' )? annoval
annoval = cond | anno | C:annolist
annolist := annoval ','
typedecl = mods ( 'class' id targs? ( 'extends' type )? ( 'implements' types )? ( 'permits' types )? C:members | 'interface' id targs? ( 'extends' types )? ( 'permits' types )? C:members | 'enum' id ( 'implements' types )? C:enumbody | '@' 'interface' id C:members | 'record' id targs? P:params ( 'implements' types )? C:members )
enumbody = consts? ','? ( ';' enumrest? )?
enumrest = member+
consts = const | consts ',' const
const = anno* id P:args? C:members?
members :: member
member = ';' | typedecl | 'static'? C:block | mods targs? ( type id P:params dims throws? ( C:block | 'default' annoval ';' | ';' ) | id P:params throws? C:block | id C:block | type vars ';' )
throws = 'throws' types
dims = ( B:none )*
none =
params := param ','
param = mods type ( '...' )? ( id dims | 'this' | name '.' 'this' )
targs = '<' targlist? '>'
targlist = targ ( ',' targ )*
targ = anno* ( type bound? | '?' bound? )
bound = ( 'extends' | 'super' ) type ( '&' type )*
types = type ( ',' type )*
type = anno* ( PRIM | classtype ) ( anno* B:none )*
classtype = id targs? | classtype '.' anno* id targs?
vars = var ( ',' var )*
var = id dims ( '=' init )?
init = expr | C:inits
inits := init ','
block :: stmt
stmt = ';' | C:block | mods type vars ';' | typedecl | expr ';' | 'if' P:expr stmt ( 'else' stmt )? | 'while' P:expr stmt | 'do' stmt 'while' P:expr ';' | 'for' P:forhead stmt | 'return' expr? ';' | 'throw' expr ';' | ( 'break' | 'continue' ) id? ';' | 'yield' expr ';' | 'assert' expr ( ':' expr )? ';' | 'synchronized' P:expr C:block | 'try' P:resources? C:block ( 'catch' P:caught C:block )* ( 'finally' C:block )? | 'switch' P:expr C:cases | id ':' stmt
resources :: resource
resource = ( mods type id '=' expr | expr ) ';'?
caught = mods type ( '|' type )* id
forhead = forinit? ';' expr? ';' exprs? | mods type id ':' expr
forinit = mods type vars | exprs
exprs = expr ( ',' expr )*
cases :: case
case = ( label ':' )+ stmt? | label '->' ( expr ';' | C:block | 'throw' expr ';' ) | stmt
label = 'case' caselabel ( ',' caselabel )* ( 'when' expr )? | 'default'
caselabel = cond | pattern | 'default'
pattern = mods type id | type P:patterns id?
patterns := pattern ','
expr = cond | unary ( ASSIGN | '=' ) expr | lambda
lambda = ( id | P:lparams ) '->' ( expr | C:block )
lparams := lparam ','
lparam = id | param
cond = binary | binary '?' expr ':' ( cond | lambda )
binary = unary | binary binop unary | binary 'instanceof' ( 'final'? type id? | type P:patterns )
binop = OP | SIGN | '*' | '&' | '|' | '<' | '>' | '>' '>' | '>' '>' '>' | '>' '='
unary = ( OP1 | SIGN | INC ) unary | P:casttype ( unary | lambda ) | postfix
casttype = type ( '&' type )*
postfix = primary | postfix INC
primary = id | NUM | STR | 'this' | 'super' | P:expr | 'this' P:args | 'super' P:args | id P:args | primary '.' ( targs? id P:args? | 'this' | 'super' P:args? | 'class' | 'new' creator ) | primary B:expr | primary '::' targs? ( id | 'new' ) | type '::' targs? ( id | 'new' ) | type '.' 'class' | 'void' '.' 'class' | PRIM '.' 'class' | 'new' creator | 'switch' P:expr C:cases
creator = anno* targs? ( PRIM | classtype ) ( P:args C:members? | ( B:expr )+ dims | ( B:none )+ C:inits )
args := expr ','
"""

RUST = """
file :: item
item = attr* vis? itemkind | attr | ';'
attr = '#' '!'? B:tokens
vis = 'pub' P:path?
path = ( 'crate' | 'self' | 'super' | 'in' )? segs?
itemkind = 'use' usetree ';' | 'mod' ID ( ';' | C:file ) | 'extern' 'crate' ( ID | 'self' ) ( 'as' ID )? ';' | 'unsafe'? 'extern' STR? C:file | fn | 'struct' ID generics? ( where? C:fields | P:tfields where? ';' | where? ';' ) | ( 'enum' ) ID generics? where? C:variants | ID ID generics? C:fields | 'unsafe'? 'impl' generics? ( '!'? type 'for' )? type where? C:assocs | 'unsafe'? ID? 'trait' ID generics? ( ':' bounds? )? where? C:assocs | 'const' ( ID | '_' ) ':' type ( '=' expr )? ';' | 'static' 'mut'? ID ':' type ( '=' expr )? ';' | 'type' ID generics? ( ':' bounds )? where? ( '=' type )? where? ';' | macro
macro = segs '!' ID? ( P:tokens ';'? | B:tokens ';'? | C:tokens )
usetree = ( '::' )? useseg
useseg = C:usetrees | '*' | useid ( 'as' ( ID | '_' ) )? | useid '::' useseg
useid = ID | 'self' | 'super' | 'crate'
usetrees := usetree ','
fn = ( 'const' | 'async' | 'unsafe' | 'extern' STR? )* 'fn' ID generics? P:params ret? where? ( C:block | ';' )
ret = '->' type
params := param ','
param = attr* ( '&' LIFE? )? 'mut'? 'self' ( ':' type )? | attr* pat ':' type | '...' | attr* type
generics = '<' glist? '>'
glist = gparam ( ',' gparam )* ','?
gparam = attr* ( LIFE ( ':' lifes? )? | ID ( ':' bounds? )? ( '=' type )? | 'const' ID ':' type ( '=' ( expr ) )? )
lifes = LIFE ( '+' LIFE )*
bounds = bound ( '+' bound )* '+'?
bound = '?'? ( 'for' generics )? tpath | LIFE | P:bound | '~'? 'const' tpath
where = 'where' ( wpred ( ',' wpred )* ','? )?
wpred = LIFE ':' lifes? | ( 'for' generics )? type ':' bounds?
fields := field ','
field = attr* vis? ID ':' type
tfields := tfield ','
tfield = attr* vis? type
variants := variant ','
variant = attr* vis? ID ( C:fields | P:tfields )? ( '=' expr )?
assocs :: assoc
assoc = attr* vis? 'default'? itemkind | attr | ';'
type = tpath | '&' LIFE? 'mut'? type | '*' ( 'const' | 'mut' ) type | B:arrtype | P:types | '!' | '_' | ( 'impl' | 'dyn' ) bounds | ( 'for' generics )? ( 'unsafe' | 'extern' STR? )* 'fn' P:params ret? | '<' type ( 'as' tpath )? '>' '::' tsegs | macro
arrtype = type ( ';' expr )?
types := type ','
tpath = '::'? tsegs
tsegs = tseg | tsegs '::' tseg
tseg = ( ID | 'self' | 'super' | 'crate' | 'Self' ) ( '::'? targs | P:types ret? )?
targs = '<' ( targ ( ',' targ )* ','? )? '>'
targ = type | LIFE | NUM | C:block | ID targs? '=' type | ID ':' bounds | STR | SIGN NUM
segs = seg | '::' seg | segs '::' seg
seg = ID | 'self' | 'super' | 'crate' | 'Self' | targs
block :: stmt
stmt = ';' | item | attr* 'let' pat ( ':' type )? ( '=' expr ( 'else' C:block )? )? ';' | attr* expr ';'? | LIFE ':' stmt
expr = assign | 'return' expr? | 'break' LIFE? expr? | 'continue' LIFE? | closure
closure = 'static'? 'async'? 'move'? ( '|' ( cparam ( ',' cparam )* ','? )? '|' | '||' ) ( expr | ret C:block )
cparam = cpat ( ':' type )?
assign = range | range ( ASSIGN | '=' | '>' '=' ) expr
range = binary | binary? ( '..' | '..=' ) binary?
binary = unary | binary binop ( unary | closure | 'return' expr? ) | binary 'as' type
binop = OP | '*' | '&' | '&&' | '|' | '||' | '<' | '>' | '>' '>' | '>' '=' | '+' | SIGN
unary = ( SIGN | '*' | '!' ) unary | ( '&' | '&&' ) ( 'mut' | 'raw' ( 'const' | 'mut' ) )? unary | 'let' pat '=' unary | post
post = prim | post '?' | post '.' ( ID ( '::' targs )? | NUM | 'await' ) | post P:args | post B:expr
prim = NUM | STR | segs | segs C:inits | '<' type ( 'as' tpath )? '>' '::' segs | P:args | B:array | C:block | 'unsafe' C:block | 'async' 'move'? C:block | 'const' C:block | if | 'match' expr C:arms | ( LIFE ':' )? ( 'loop' C:block | 'while' expr C:block | 'for' pat 'in' expr C:block | C:block ) | macro | '_'
if = 'if' expr C:block ( 'else' ( if | C:block ) )?
inits := init ','
init = attr* ( ID | NUM ) ( ':' expr )? | '..' expr?
args := argx ','
argx = attr* expr
array = expr ';' expr | ( expr ( ',' expr )* ','? )?
arms :: arm
arm = attr* '|'? pat ( 'if' expr )? '=>' ( expr ','? | C:block ','? ) | arm arm
pat = pat1 | pat '|' pat1
cpat = pat1
pat1 = '_' | '..' | ( 'ref' )? 'mut'? ID ( '@' pat1 )? | SIGN? NUM | STR | segs ( P:pats | C:pfields )? | ( '&' | '&&' ) 'mut'? pat1 | P:pats | B:pats | pat1? ( '..=' | '..' ) pat1? | macro | 'const' C:block | 'box' pat1
pats := pat ','
pfields := pfield ','
pfield = attr* ( '..' | 'ref'? 'mut'? ID | ( ID | NUM ) ':' pat )
tokens = any*
any = ID | NUM | STR | LIFE | OP | SIGN | ASSIGN | P:tokens | B:tokens | C:tokens | ',' | ';' | ':' | '::' | '.' | '..' | '..=' | '...' | '=' | '=>' | '->' | '<' | '>' | '&' | '&&' | '|' | '||' | '*' | '+' | '!' | '?' | '#' | '@' | '~' | '$' | '_' | KEY | 'pub' | 'crate' | 'self' | 'super' | 'in' | 'use' | 'mod' | 'extern' | 'as' | 'unsafe' | 'struct' | 'enum' | 'impl' | 'for' | 'trait' | 'const' | 'static' | 'mut' | 'type' | 'async' | 'fn' | 'where' | 'dyn' | 'Self' | 'let' | 'else' | 'return' | 'break' | 'continue' | 'move' | 'await' | 'match' | 'loop' | 'while' | 'if' | 'ref' | 'default' | 'box' | 'raw'
"""

PYTHON = """
file :: stmt
block :: stmt
stmt = simple NL | compound | DECO NL
simple = small ( ';' small )* ';'?
small = tests | ( places '=' )+ ( tests | 'yield' ytail? ) | place ':' test ( '=' ( tests | 'yield' ytail? ) )? | place ASSIGN ( tests | 'yield' ytail? ) | 'pass' | 'break' | 'continue' | 'return' tests? | 'raise' ( test ( 'from' test )? )? | ( 'global' | 'nonlocal' ) ID ( ',' ID )* | 'del' places | 'assert' test ( ',' test )? | 'import' dotted ( 'as' ID )? ( ',' dotted ( 'as' ID )? )* | 'from' from 'import' ( '*' | P:imported | aliases ) | 'yield' ytail? | 'type' ID B:typars? '=' test
ytail = 'from' test | tests
dotted = ID | dotted '.' ID
from = dots? dotted | dots
dots = ( '.' | '...' )+
imported := alias ','
aliases = alias ( ',' alias )*
alias = ID ( 'as' ID )?
suite = I:block | simple NL
compound = 'if' named ':' suite ( 'elif' named ':' suite )* ( 'else' ':' suite )? | 'while' named ':' suite ( 'else' ':' suite )? | 'async'? 'for' targets 'in' tests ':' suite ( 'else' ':' suite )? | 'try' ':' suite ( ( 'except' '*'? ( tests ( 'as' ID )? )? ':' suite )+ ( 'else' ':' suite )? ( 'finally' ':' suite )? | 'finally' ':' suite ) | 'async'? 'with' ( items | P:items ) ':' suite | deco* 'async'? 'def' ID B:typars? P:params ( '->' test )? ':' suite | deco* 'class' ID B:typars? P:args? ':' suite | 'match' tests ':' I:cases
deco = '@' named NL
items = item | items ',' item | items ','
item = test ( 'as' target )?
cases :: case
case = 'case' pats ( 'if' named )? ':' suite
pats = pat ( ',' pat )* ','?
pat = '*'? test ( 'as' ID )?
typars := typar ','
typar = ( '*' | '**' )? ID ( ':' test )? ( '=' test )?
params := param ','
param = ID ( ':' test )? ( '=' test )? | '*' ( ID ( ':' '*'? test )? )? | '**' ID ( ':' test )? | '/'
lparams = lparam ( ',' lparam )* ','?
lparam = ID ( '=' test )? | '*' ID? | '**' ID | '/'
targets = places
target = place
places = starred ( ',' starred )* ','?
starred = '*'? place
place = ID | power '.' ID | power B:subs | P:inner | B:inner
inner = places?
tests = tstar ( ',' tstar )* ','?
tstar = named | '*' chain
named = test | ID ':=' test
test = chain | chain 'if' chain 'else' test | 'lambda' lparams? ':' test
chain = un | chain ( OP | SIGN | COMP | '*' | '**' | '/' | '@' | 'and' | 'or' | 'in' | 'not' 'in' | 'is' 'not'? ) un
un = ( SIGN | '~' | 'not' ) un | power
power = 'await'? atom trail*
trail = '.' ID | P:args | B:subs
atom = ID | NUM | ( STR S:field* )+ | '...' | P:paren | B:listing | C:setting
field = tests | 'yield' ytail?
paren = ( tests | ( named | '*' chain ) comp | 'yield' ytail? )?
listing = ( tests | named comp )?
setting = ( entry ( ',' entry )* ','? | test ':' test comp | named comp )?
entry = test ':' test | '**' chain | named | '*' chain
comp = ( 'async'? 'for' targets 'in' chain ( 'if' condif )* )+
condif = chain | ID ':=' test | 'lambda' lparams? ':' test
args := arg ','
arg = named comp? | ID '=' test | '*' test | '**' test
subs := sub ','
sub = named | test? ':' test? ( ':' test? )? | '*' chain
"""

JSON = """
file = value
value = STR | NUM | WORD | C:object | B:array
object = ( pair ( ',' pair )* )?
pair = STR ':' value
array = ( value ( ',' value )* )?
"""

YAML = """
file = docs
docs = I:node? ( DOC NL? I:node? )*
node = PROP* NL? ( mapping | sequence | ( flow | SCALAR | BLOCK | ALIAS )? NL? )
mapping = pair+
pair = KEY PROP* ( SCALAR NL | BLOCK NL | flow NL | ALIAS NL | NL ( I:node | sequence )? )
sequence = ( DASH ( PROP* ( SCALAR NL | BLOCK NL | flow NL | ALIAS NL | I:node | NL I:node? ) ) )+
flow = C:fmap | B:fseq
fmap := fpair ','
fpair = ( STR | SCALAR | PROP )* ( ':' fvalue? )?
fseq := fitem ','
fitem = fvalue ( ':' fvalue? )?
fvalue = PROP* ( SCALAR | STR | ALIAS | flow )
"""

SHELL = """
file = list?
list = seps? andor ( sepr andor )* seps?
seps = ( NL )+
sepr = seps | ( ';' | '&' ) seps?
andor = pipe | andor ( '&&' | '||' ) seps? pipe
pipe = '!'? command | pipe ( '|' | '|&' ) seps? command
command = simple | compound redir* | func
simple = part+
part = WORD | ASSIGN | redir | ASSIGN P:words | WORD P:words
words = ( WORD | NL | ASSIGN )*
redir = REDIR WORD | HEREDOC
func = WORD P:none seps? compound redir* | 'function' WORD P:none? seps? compound redir*
none =
compound = G:body | P:body | 'if' body 'then' body ( 'elif' body 'then' body )* ( 'else' body )? 'fi' | ( 'while' | 'until' ) body 'do' body 'done' | 'for' WORD seps? ( 'in' ( WORD | ASSIGN )* )? ( ';' | NL )* 'do' body 'done' | 'for' ARITH ';'? seps? 'do' body 'done' | 'select' WORD ( 'in' WORD* )? ( ';' | NL )* 'do' body 'done' | 'case' WORD seps? 'in' seps? clause* 'esac' | TEST | ARITH
body = seps? andor ( sepr andor )* ( ';' | '&' )? seps?
clause = 'OPEN'? WORD ( '|' WORD )* 'CLOSE' body? seps? ( ( ';;' | ';&' | ';;&' ) seps? )?
"""


def _arguments(parts: list[tuple]) -> list[int]:
    """Arguments of a Python call out of order: one without a name after a named one, or a * after a **."""
    wrong, named, mapped = [], False, False
    for n, part in enumerate(parts):
        if part[:1] == ("**",):
            mapped = named = True
        elif part[:1] == ("*",):
            wrong += [n] * mapped
        elif len(part) > 1 and part[1] == "=":
            named = True
        else:
            wrong += [n] * named
    return wrong


def _parameters(parts: list[tuple]) -> list[int]:
    """Parameters of a Python function out of order: without a default after one with it, anything after **, a second *, a late /."""
    wrong, default, star, slash, last = [], False, False, False, False
    for n, part in enumerate(parts):
        if last:
            wrong.append(n)
        elif part[:1] == ("**",):
            last = True
        elif part[:1] == ("*",):
            wrong += [n] * (star or len(part) == 1 and n == len(parts) - 1)
            star, default = True, False
        elif part == ("/",):
            wrong += [n] * (slash or star or not n)
            slash = True
        elif "=" in part:
            default = not star
        else:
            wrong += [n] * default
    return wrong


@lru_cache(maxsize=None)
def grammar(language: str) -> Grammar:
    if language in ("javascript", "typescript"):
        base = SCRIPT
        extra = TYPES if language == "typescript" else NO_TYPES
        upper = re.findall(r"^(\w+) =", TYPES, re.M)
        body = base.replace("DECO* ", "( '@' left )* ")
        for name in sorted((n for n in upper if n.isupper()), key=len, reverse=True):
            here = f"x{name.lower()}"
            body, extra = re.sub(rf"\b{name}\b", here, body), re.sub(rf"\b{name}\b", here, extra)
        if language == "javascript":
            # What only TypeScript has can't be matched: a token that no lexer makes.
            missing = [n for n in upper if n.isupper() and not re.search(rf"^x{n.lower()} =", extra, re.M)]
            extra += "".join(f"\nx{n.lower()} = 'no such token'" for n in missing)
        return Grammar(body.strip() + "\n" + extra.strip(), ("else", "catch", "finally", "while", ".", "?.", "OP", "OP1", "?", ":", ",", "=>", "=", "ASSIGN", "(", "[", "{", "in", "of", "instanceof", "as", "SIGN", "*", "<", ">", "&", "|", "from", "extends", "implements", "satisfies"))
    orders = {"args": _arguments, "params": _parameters} if language == "python" else {}
    text, more = {
        "go": (GO, ()),
        "java": (JAVA, ("else", "catch", "finally", "while", ".", ")", "(", "OP", "SIGN")),
        "rust": (RUST, ("else", ".", "?", "OP", "SIGN", "=>", "as", "where", ",", "(", "[", "..", "{", "&&", "||", "|", "*", "&")),
        "python": (PYTHON.replace("| DECO NL", ""), ("elif", "else", "except", "finally", "def", "class", "async", "@", "I")),
        "json": (JSON, ()),
        "yaml": (YAML, ()),
        "shell": (SHELL.replace("G:body", "C:body"), ()),
    }[language]
    return Grammar(text.strip(), more, blocks_end=language != "go", orders=orders)

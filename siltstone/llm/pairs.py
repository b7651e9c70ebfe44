"""Broken prompt and response pairs: each defective pair with its kind of defect.

* copy: a suffix automaton of the prompt is walked along the response; what it covers is copied.
* refusal: an automaton of parts of refusals (who speaks, a denial, what an answer would do, the sources) reads each
  sentence; rules say which parts must follow each other. The whole response must decline.
* truncated: stacks of delimiters (code blocks, code spans, citations, list items) must be closed, and a
  response without a final mark must end as sentences of the whole corpus end, be it with one word or in Japanese;
  code spans, paths, headings, quotations, list items of one word and whole responses of one word are complete.
* language: every sentence votes for a language by its stop words and letters.
* empty, dangling: no letter or digit; a bracketed number that no chunk has.

One defect is given for each pair, the first of empty, copy, refusal, truncated, language; dangling comes beside.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import ahocorasick
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siltstone.session import materialize

# ---- Fixed values: words and phrases of the languages that answers are written in. ----

STOP_WORDS = {
    "en": "the a an and or not is are was were be been in on at to for of with it this that from by as if does has have had no so but its which what where who why how when than then each only before after there one can all more because into through without up they until during any them many much few",
    "de": "der die das und oder nicht ist sind war wird werden wurde in im am zu zum zur für von vom mit es dieser diese dieses den dem des ein eine einen einer als wenn auf aus bei nach nur noch auch so aber was wo wer wie warum welche welcher welches hat haben kann muss müssen jetzt wir sie ich mehr sich außerdem an",
    "fr": "le la les et ou ne pas est sont était a été être dans en sur à au aux pour de du des avec il elle ce cette ces par si que qui quoi où comment pourquoi quel quelle un une plus on je son sa ses leur tant après avant jusqu'à même très se",
    "es": "el la los las y o no es son fue ser en a al para de del con lo este esta esto por si que qué quién dónde cómo cuál un una más se su sus cuando también además sólo sin pero hay debería donde después cada según porque sobre entre",
    "pt": "o a os as e ou não é são foi ser em no na nos nas ao para de do da dos das com este esta isto por se que quem onde como qual um uma mais seu sua quando também só sem mas há então após cada pela pelo você depois",
    "nl": "het een niet ook zijn worden wordt maar dat voor aan uit naar bij deze dit waar wanneer omdat hebben heeft geen zonder welke hoe waarom wij zij nog wel dan",
    "it": "il gli che della delle degli dei non più sono essere perché quando questo questa anche dal dalla nel nella viene dove quale come dopo prima senza sui sulla ogni stato",
    "sv": "och inte är att som det den för på av till från när var hur varför också efter innan utan eller har hade kan ska denna detta vilken alla",
    "pl": "i lub nie jest są był była było w na do dla od z ze to ten ta te przez jeśli że kto gdzie jak dlaczego który która które się po przed oraz ale już tylko więc co czy może gdy jej jego też będzie została żeby dziś każdym",
}
LETTERS = {"de": "äöüß", "es": "ñ¿¡", "pt": "ãõ", "pl": "ąęłńśźżć", "fr": "êèçàùœîôë", "it": "ìò"}
#: Letters of scripts that name a language, or a group of languages, by themselves.
SCRIPTS = {"ja": "\u3040-\u30ff\uff66-\uff9f", "ru": "\u0400-\u04ff", "el": "\u0370-\u03ff", "he": "\u0590-\u05ff", "ar": "\u0600-\u06ff", "hi": "\u0900-\u097f", "th": "\u0e00-\u0e7f", "ko": "\uac00-\ud7a3"}
HAN = "\u3400-\u9fff"
# Parts of refusals, by language: a sentence declines if parts of certain kinds follow each other closely (see RULES).
# Each part is the beginning of one or more words.
PARTS = {
    # who speaks
    "self": """
        i |i'm |i'd |i've |i'll |we |my |leaves me|for me|this assistant
        ich |mir |wir |man |m'|lässt sich |lassen sich |je |j'|nous |yo |me |nos |lo que |eu |mim |nós |posso |consigo |prefiro |quero |puedo |quiero |prefiero |consigo |ja |mi |mnie |da się |mam |wolę |mogę |potrafię |umiem |я |мне |мы |私|こちら
        """,
    # what keeps it from answering
    "not": """
        cannot |can't |can not |could not |couldn't |won't |will not |would not |wouldn't |shall not |unable|not able|don't |do not |didn't |did not |am not |'m not |not going|not in a position|not willing|refuse|declin|rather not|prefer not|hesitat|have to pass|must pass|no way |no means|no idea|no clue|not sure|not certain|unsure|uncertain|refrain|abstain|avoid|impossible|not possible|hard to |difficult to |unclear|beyond what|lack |too little|too few|without |none of|never |nothing |isn't |aren't |doesn't |wasn't |weren't |hasn't |haven't |outside |beyond |irresponsible|missing |insufficient|before i |until i |unless i |instead of |no basis|no grounds|no conclusion|nothing to |not |no 
        nicht|kein|fehl|unmöglich|außerstande|weiger|passen |verzicht|unklar|vermag
        pas |ne |impossible|incapable|refus|abstien|aucun|rien |saurais
        no |imposible|incapaz|neg|absten|prefiero no|sin |ningun|desconozco|tampoco 
        não |nao |impossível|incapaz|recus|abst|prefiro não|sem |nenhum|desconheço
        nie |niemożliw|odmawia|trudno|brak|bez |żadn
        не |нельзя|невозможно|отказ|воздерж|нет |без |затрудн
        ません|できない|できかね|控え|かねます|不可能|難し|不明
        """,
    # what an answer would do
    "answer": """
        answer|say |say.|say,|say whe|say wha|say how|say why|tell|determin|know|confirm|help|provid|respon|reply|comment|speculat|guess|find |find.|locate|assist|give |offer|verify|establish|infer|conclu|identify|explain|work out|work that out|make out|judge|decide|point to|resolv|address|be sure|be certain|pin down|pin that down|settle|figure|go on|go by|the information|the context|the details|enough to|evidence to|state |vouch|claim|assert|certain|sure |sure.|sure,|idea|clue
        antwort|beantwort|sagen|wissen|weiß|helfen|weiterhelfen|raten|spekulier|beurteil|auskunft|aussage|bestätig|ermitteln|bestimmen|erklär|mutmaß|vermut|klären|einschätz|nötigen|informationen|angaben|feststell|dazu 
        répon|dire |dire.|dire,|savoir|sais |sais.|aider|devin|spécul|affirm|déterminer|confirmer|conclu|expliquer|trouver|fournir|prononcer|avancer
        respond|respuesta|decir|sé |sé.|sabría|saber|ayudar|adivin|especul|determinar|confirmar|afirmar|explicar|encontrar|conclu|asegurar|precisar
        respond|resposta|dizer|sei |sei.|saberia|saber|ajudar|adivin|especul|determinar|confirmar|afirmar|explicar|encontrar|conclu|garantir
        odpowied|odpowiad|powiedzieć|wiem|pomóc|zgad|spekul|określić|ustalić|potwierdzić|stwierdzić|wyjaśni|stanie |potrafi|informac|wystarcz|danych
        ответ|отвеч|сказать|знаю|помочь|гада|спекул|строить|определить|подтвердить|утвержд|объясн|сообщ|установ|предпол|судить|берусь
        答え|回答|わかり|分かり|判断|特定|推測|手伝|お伝え|説明|確認|断定|申し上げ
        """,
    # said of an answer that isn't given
    "open": """
        be answered|be determined|be told|be known|be confirmed|be said|be settled|be resolved|be established|be inferred|unanswered|making things up|making it up|making this up|making something up|make something up|invent|fabricat|stays open|remains open|leave this open|leave it open|leave that open|be a guess|be guess|be speculation|guesswork|pure speculation|before i could say|answer can be given|answer is possible
        beantworten lässt|beantwortet werden|bleibt offen|bleibt unbeantwortet|geraten|reine spekulation|lässt sich
        reste ouverte|reste sans réponse|serait deviner|serait une supposition|sería adivinar|sería una suposición|queda abierta|queda sin respuesta|seria adivinh|seria um palpite|fica em aberto|fica sem resposta|pozostaje otwart|pozostaje bez odpowiedzi|byłoby zgad|остаётся без ответа|остается без ответа|остаётся открыт|остается открыт|было бы догадк|было бы гадани
        """,
    # that something isn't in the sources
    "lack": """
        contain|include|mention|provid|implemented in|found in|exist in|cover|touch|relate|show|describ|reveal|clear|hold|obvious|say|says|said|give|offer|explain|defin|address|indicat|discuss|specif|refer|information|detail|evidence|trace|sign of|hint|clue|enough|insufficient|missing|absent|none of|nothing|stops before|outside|part of|in the |in what |in these |in those |in any |support|answer|reach|tell|speak|help|point|basis|relevant|documented|present
        enthalt|enthält|erwähn|hinweis|sagen|sagt|reicht|reichen|zeig|beschreib|information|angabe|genüg|steht|finde|hervor|über
        parl|mentionn|contien|rien|information|indiqu|montr|précis|décri|suffi|évoqu|trouv|permet
        menciona|contien|habla|nada|información|indica|muestra|describe|basta|sufic|explica|permite|aparece
        fala|menciona|contê|contém|nada|informa|indica|mostra|descreve|basta|sufic|explica|permite|aparece
        wspomina|zawiera|nic |informac|wskazuj|pokazuj|opisuj|mało|wystarcz|wynika|mówi|ma 
        ничего|упомина|содерж|информац|указан|показ|описан|хватает|достаточ|следует|говор|сказано|есть
        記載|含ま|見つか|言及|あり|書かれ|示さ|触れ|情報|足り
        """,
    # words that turn the sources down by themselves
    "none": """
        nothing|no |none|neither|kein|nichts|rien|aucun|nada|no hay|ningun|nenhum|nic |żadn|brak|ничего|нет |ません|ない
        """,
    # a refusal by itself, where somebody speaks
    "refuse": """
        declin|have to pass|must pass|refuse to|have to refuse|must refuse|abstain|refrain|no comment|no idea|no clue|passen |weigere|enthalte|m'abstiens|refuse de|me abstengo|abstenho|odmawiam|воздержусь|отказываюсь|控えさせ|控えます
        """,
    "source": """
        chunk|excerpt|context|snippet|material|was handed|was given|were given|am given|been given|i have |i was shown|i can see|provided|supplied|listing|passage|retrieved|these files|given files|these lines|sources|what you sent|what you shared|the code shown|above|at hand|in front of me
        ausschnitt|auszüge|auszug|kontext|dateien|vorliegend|unterlagen|gezeigte|mir vorlieg
        extrait|contexte|fichiers|passages|fournis
        fragmento|contexto|extracto|archivos|proporcion
        trecho|contexto|arquivos|fornecid
        fragment|kontekst|plik|podan|dostarcz
        фрагмент|контекст|отрыв|предоставл|файл|приведённ|приведенн
        抜粋|コンテキスト|断片|チャンク|文脈|提示され|与えられ|資料
        """,
}
#: Kinds that must follow each other, each beginning at most this many characters after the one before began.
RULES = (("self", "not", "answer"), ("self", "answer", "not"), ("not", "self", "answer"), ("not", "answer", "open"), ("self", "open"), ("not", "open"), ("open", "not"), ("self", "refuse"))
NEAR = 60
#: A denial that comes after the verb comes this soon.
NEXT = 18
#: What may stand before a denial that opens a sentence.
OPENING = re.compile(r"(?:[\w' ]{1,25}, )?")
#: In these languages the denial ends the sentence, or the speaker goes unnamed.
UNNAMED = re.compile(r"[ぁ-ヿ一-鿿]|^(?:no|não|nie|не|nao|on |brak|trudno|нельзя|невозможно|imposible|impossível|impossible|niemożliw|prefiero|prefiro|desconozco|desconheço)\b")
#: A sentence of these neither answers nor declines beside one that declines.
POLITE = "sorry|please|unfortunately|tut mir leid|entschuldig|bitte|désolé|veuillez|lo siento|por favor|desculp|przykro|przepraszam|proszę|извините|пожалуйста|申し訳|すみません"
#: Words in which a prompt or a response wraps a question that it only repeats.
WRAPPING = "question: answer: q: a: context: prompt: you asked your question was the question is the question was (no chunks retrieved) answer the question based on the chunks above frage: antwort: pregunta: respuesta: pergunta: resposta: réponse: pytanie: odpowiedź: вопрос: ответ: 質問: 回答:"

WORD = re.compile(r"[^\W_]+")
FENCE = re.compile(r"^[ \t]*(```|~~~)", re.M)
CITATION = re.compile(r"\[[0-9]+\]")
CJK = r"぀-ヿ㐀-鿿ｦ-ﾟ"
SENTENCE = re.compile(r"(?<=[.!?])[\"”»)*]*\s+|(?<=[。！？])|\n+")
ONE_WORD = re.compile(r"[ぁ-ゖー]+|[^\W_ぁ-ゖ]+(?:['’-][^\W_ぁ-ゖ]+)*")
FINAL = ".!?。！？…"
SHORT = 3


class SuffixAutomaton:
    """All substrings of a text; `covered` marks the parts of another text that occur in it."""

    def __init__(self, text: str) -> None:
        self.next: list[dict[str, int]] = [{}]
        self.link, self.length = [-1], [0]
        last = 0
        for c in text:
            now = self._state(self.length[last] + 1, {})
            p = last
            while p >= 0 and c not in self.next[p]:
                self.next[p][c] = now
                p = self.link[p]
            if p < 0:
                self.link[now] = 0
            else:
                q = self.next[p][c]
                if self.length[p] + 1 == self.length[q]:
                    self.link[now] = q
                else:
                    twin = self._state(self.length[p] + 1, dict(self.next[q]))
                    self.link[twin] = self.link[q]
                    while p >= 0 and self.next[p].get(c) == q:
                        self.next[p][c] = twin
                        p = self.link[p]
                    self.link[q] = self.link[now] = twin
            last = now

    def _state(self, length: int, follow: dict[str, int]) -> int:
        self.next.append(follow)
        self.link.append(-1)
        self.length.append(length)
        return len(self.next) - 1

    def covered(self, text: str, least: int) -> list[bool]:
        marks = [False] * len(text)
        state = size = done = 0
        for i, c in enumerate(text):
            while state and c not in self.next[state]:
                state = self.link[state]
                size = self.length[state]
            if c in self.next[state]:
                state = self.next[state][c]
                size += 1
            if size >= least:
                for j in range(max(done, i + 1 - size), i + 1):
                    marks[j] = True
                done = i + 1
        return marks


@lru_cache(4096)
def _automaton(prompt: str) -> SuffixAutomaton:
    return SuffixAutomaton(prompt)


def _plain(text: str) -> str:
    return " ".join(WORD.findall(text.casefold()))


@lru_cache(1)
def _wrapping() -> SuffixAutomaton:
    return SuffixAutomaton(" " + " ".join(WORD.findall(WRAPPING)) + " ")


#: Characters of a response that are looked at first for a word that the prompt lacks.
BEGINNING = 64


def is_copy(prompt: str, text: str) -> bool:
    """The response's words come from the prompt or from wrapping words, but for a twelfth of the letters at most."""
    said, asked = _plain(text), _plain(prompt)
    if not said:
        return False
    least = min(5, len(asked) + 2)
    if len(said) > BEGINNING:
        # A new word is enough to tell, and most answers have one soon; marks of a word depend on no more than `least` characters after it.
        begin = f" {said[:BEGINNING]}"
        marks, own = _automaton(f" {asked} ").covered(begin, least)[1:], _wrapping().covered(begin, 3)[1:]
        if any(m.end() + least <= BEGINNING and not any(marks[m.start() : m.end()]) and not any(own[m.start() : m.end()]) for m in WORD.finditer(said, 0, BEGINNING)):
            return False
    marks = _automaton(f" {asked} ").covered(f" {said} ", least)[1:-1]
    if sum(marks) < 0.5 * min(len(said), len(asked)):
        return False
    own = _wrapping().covered(f" {said} ", 3)[1:-1]
    left = sum(c != " " and not a and not b for c, a, b in zip(said, marks, own))
    # A number, name or path that the prompt lacks is an answer, however short.
    new = any(not any(marks[m.start() : m.end()]) and not any(own[m.start() : m.end()]) for m in WORD.finditer(said))
    return left <= len(said) / 12 and not new


def _phrases(text: str) -> list[str]:
    return [p.casefold() for line in text.strip("\n").split("\n") for p in line.lstrip().split("|") if p.strip()]


@lru_cache(1)
def _refusals() -> ahocorasick.Automaton:
    """All parts with their kinds."""
    a = ahocorasick.Automaton()
    kinds: dict[str, list[str]] = {}
    for kind, text in (*PARTS.items(), ("polite", POLITE)):
        for p in _phrases(text):
            kinds.setdefault(p, []).append(kind)
    for p, own in kinds.items():
        a.add_word(p, (len(p), tuple(own)))
    a.make_automaton()
    return a


def _parts(sentence: str) -> list[tuple[int, str]]:
    """(place, kind) of the parts of refusals in a sentence in lower case; parts begin where words do."""
    text = f" {sentence} "
    found = []
    for end, (size, kinds) in _refusals().iter(text):
        at = end - size + 1
        before = text[at - 1]
        if not (before.isalnum() and before < "\u3000" and text[at].isalnum()):
            found += [(at, kind) for kind in kinds]
    return sorted(found)


def _follow(parts: list[tuple[int, str]], rule: tuple[str, ...], near: int = NEAR) -> bool:
    """Whether parts of the rule's kinds follow each other closely."""
    ends = [at for at, kind in parts if kind == rule[0]]
    for kind in rule[1:]:
        ends = [at for at, k in parts if k == kind and any(e < at <= e + near for e in ends)]
    return bool(ends)


def declines(sentence: str) -> bool | None:
    """Whether a sentence (in lower case) declines; None if it neither declines nor answers: it is polite, or speaks of the sources only."""
    parts = _parts(sentence)
    kinds = {k for _, k in parts}
    if any(_follow(parts, r) for r in RULES):
        return True
    if {"lack", "source"} <= kinds and (_follow(parts, ("not", "lack")) or _follow(parts, ("lack", "none"), NEXT)):
        return True
    # Without a speaker: "Unable to tell", "No sé", and languages that leave it out.
    first = min((at for at, k in parts if k == "not"), default=len(sentence))
    if ({"answer", "refuse"} & kinds) and (first in (1, OPENING.match(sentence).end() + 1) and (_follow(parts, ("not", "answer")) or "refuse" in kinds) or UNNAMED.search(sentence) and (_follow(parts, ("answer", "not")) or _follow(parts, ("not", "answer")))):
        return True
    return None if kinds & {"source", "polite"} else False


def prose(text: str, spans: str = " `x` ") -> str:
    """Text without code blocks, with `spans` for code spans, without citations and quotations."""
    text = re.sub(r"```.*?(?:```|\Z)", "\n", text, flags=re.S)
    text = re.sub(r"`[^`\n]*`", spans, text)
    text = CITATION.sub("", text)
    return re.sub(r"\"[^\"\n]*\"|“[^”\n]*”|«[^»\n]*»|„[^“”\n]*[“”]", ' "" ', text)


def sentences(text: str) -> list[str]:
    return [s for s in (x.strip() for x in SENTENCE.split(text)) if WORD.search(s)]


def is_refusal(prompt: str, text: str) -> bool:
    """At least one sentence declines, and none of the others answers."""
    asked, declined = _plain(prompt), False
    for s in sentences(prose(text)):
        said = declines(s.casefold().replace("’", "'"))
        if said is False and _plain(s) != asked:
            return False
        declined = declined or bool(said)
    return declined


def open_end(text: str) -> str | None:
    """"cut" if a delimiter, list item or mark is left open; None if the response is closed; else the key of its last words."""
    body = text.rstrip()
    if len(FENCE.findall(body)) % 2:
        return "cut"
    last = body.rsplit("\n", 1)[-1]
    if re.match(r"[ \t]*(```|~~~)", last):
        return None
    outside = re.sub(r"```.*?```", "", body, flags=re.S)
    if outside.count("`") % 2 or outside.count("**") % 2 or re.search(r"\[[0-9]*\Z", body):
        return "cut"
    if re.fullmatch(r"\s*(?:[0-9]+[.)]|[-*+])", last):
        return "cut"
    bare = re.sub(r"(?:\s*\[[0-9]+\])+\Z", "", body).rstrip()
    end = bare.rstrip("\"”»)*_")
    if not end or end[-1] in FINAL:
        return None
    if bare[-1] in ",;:([{/–—-&=<+" or bare.count("“") > bare.count("”"):
        return "cut"
    line = re.sub(r"\A\s*(?:\[[0-9]+\]\s*)+", "", SENTENCE.split(bare)[-1])
    item = re.sub(r"\A\s*(?:[0-9]+[.)]|[-*+>])\s+", "", line)
    if re.fullmatch(r"`[^`]*`|[\w./-]*\w\.[A-Za-z]\w{0,4}|\*\*.*\*\*", item) or item.startswith("#"):
        return None
    # A word by itself is complete as a list item or as the whole response; so is a name, path or quotation.
    if ONE_WORD.fullmatch(item.strip()) and (item != line or item.strip() == bare.strip()):
        return None
    key = tail(bare)
    return None if key in ("", "x", "q") else key


def tail(text: str) -> str:
    """The last words of a text as a key: names in code spans and numbers count alike."""
    line = re.sub(r"\"[^\"\n]*\"|“[^”\n]*”", " Q ", SENTENCE.split(text)[-1])
    line = re.sub(r"`[^`]*`", " X ", CITATION.sub(" ", line))
    line = re.sub(r"\S*[\w-][./_][\w]\S*", " X ", line)
    if re.search(rf"[{CJK}]\W*\Z", line):
        return re.sub(r"\s", "", re.sub(r"[0-9]+", "0", line)).rstrip(FINAL)[-4:]
    words = re.findall(r"[\w'’]+", re.sub(r"[0-9]+", "0", line))
    return " ".join(words[-3:]).casefold()


def endings(text: str) -> set[str]:
    """The keys of all sentences of a text that end with a final mark."""
    whole = re.sub(r"```.*?(?:```|\Z)", "\n", text, flags=re.S)
    return {tail(re.sub(r"(?:\s*\[[0-9]+\])+\Z", "", s.rstrip("\"”»)* ").rstrip(FINAL)).rstrip(FINAL)) for s in SENTENCE.split(CITATION.sub("", whole)) if s.rstrip("\"”»)* ").endswith(tuple(FINAL))}


@lru_cache(1)
def _votes() -> dict[str, dict[str, float]]:
    votes: dict[str, dict[str, float]] = {}
    lists = {k: set(v.split()) for k, v in STOP_WORDS.items()}
    for lang, words in lists.items():
        for w in words:
            votes.setdefault(w, {})[lang] = 1 / sum(w in x for x in lists.values())
    return votes


NAMES = re.compile(r"[._/\\]\w|[a-z][A-Z]|[0-9]")
LETTERED = {lang: re.compile(f"[{marks}]") for lang, marks in LETTERS.items()}
SCRIPTED = {lang: re.compile(f"[{marks}]") for lang, marks in SCRIPTS.items()}
TOKEN = re.compile(r"[^\W\d_]+(?:'[^\W\d_]+)?")
HANZI = re.compile(f"[{HAN}]")


@lru_cache(65_536)
def language(sentence: str) -> tuple[str | None, int]:
    """(language, words) of a sentence without names; None if the votes are even."""
    plain = sentence.isascii()
    text = " ".join(w for w in sentence.split() if not NAMES.search(w))
    words = TOKEN.findall(text.replace("’", "'").lower())
    if not plain:
        letters = sum(map(len, words)) or 1
        counts = {lang: len(rx.findall(sentence)) for lang, rx in SCRIPTED.items()}
        han = len(HANZI.findall(sentence))
        lang = max(counts, key=counts.__getitem__)
        if counts["ja"] and counts["ja"] + han > 0.3 * letters:
            return "ja", max(1, (counts["ja"] + han) // 2)
        if han > 0.3 * letters:
            return "zh", max(1, han // 2)
        if counts[lang] > 0.3 * letters:
            return lang, len(words)
    score: dict[str, float] = {}
    votes = _votes()
    for w in words:
        for lang, v in votes.get(w, {}).items():
            score[lang] = score.get(lang, 0.0) + v
        if "'" in w and w.split("'")[0] in ("l", "d", "n", "qu", "s", "j", "c", "m"):
            score["fr"] = score.get("fr", 0.0) + 1
    if not plain:
        marked = [w for w in words if not w.isascii()]
        for lang, rx in LETTERED.items():
            if n := sum(rx.search(w) is not None for w in marked):
                score[lang] = score.get(lang, 0.0) + 0.6 * n
    best = sorted(score.values(), reverse=True)
    if not best or best[0] < 0.5 or len(best) > 1 and best[0] - best[1] < 0.15:
        return None, len(words)
    return max(score, key=score.__getitem__), len(words)


def is_foreign(prompt: str, text: str) -> bool:
    """More than half of the words of sentences in a known language are in another than the question's."""
    asked = language(prose(prompt, " "))[0]
    if asked is None:
        return False
    own = other = 0
    same = _plain(prompt)
    for s in sentences(prose(text, " ")):
        if _plain(s) == same:
            continue
        lang, n = language(s)
        if lang == asked:
            own += n
        elif lang:
            other += n
    return other > own


@lru_cache(16_384)
def inspect(prompt: str | None, text: str | None, chunks: int) -> tuple[str | None, str | None, bool]:
    """(defect, key of open last words, dangling) of a pair by itself."""
    if text is None or not WORD.search(text):
        return "empty", None, False
    dangling = any(not 1 <= int(m[0][1:-1][:18]) <= chunks for m in CITATION.finditer(text))
    prompt = prompt or ""
    if prompt and is_copy(prompt, text):
        return "copy", None, dangling
    if is_refusal(prompt, text):
        return "refusal", None, dangling
    end = open_end(text)
    if end == "cut":
        return "truncated", None, dangling
    return ("language" if is_foreign(prompt, text) else None), end, dangling


def find(df: DataFrame, id_col: str, prompt_col: str, text_col: str, chunks_col: str) -> DataFrame:
    """(id, defect): one row per pair and defect, at most one of empty, copy, refusal, truncated, language, and dangling.

    Null chunk counts are 0, null prompts are empty: such pairs can't be copies or in another language.
    Rows with the same prompt and text get the same defects; rows without a defect have no row.
    """
    kind = dict(df.dtypes)[id_col]
    rows = df.select(F.col(id_col).alias("id"), F.col(prompt_col).alias("prompt"), F.col(text_col).alias("text"), F.coalesce(F.col(chunks_col), F.lit(0)).alias("chunks"))

    def look(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            text = b["text"].where(b["text"].notna(), None)
            prompt = b["prompt"].where(b["prompt"].notna(), None)
            found = [inspect(p, t, int(n)) for p, t, n in zip(prompt, text, b["chunks"])]
            out = pd.DataFrame(found, columns=["defect", "ends", "dangling"], dtype=object)
            out.insert(0, "id", b["id"].to_numpy())
            yield out.assign(dangling=out["dangling"].astype(bool))

    def ends(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({"ends": sorted({k for t in b["text"] if t for k in endings(t)})}, dtype=object)

    seen = materialize(rows.mapInPandas(look, f"id {kind}, defect string, ends string, dangling boolean"), "seen")
    # How complete sentences end, over all texts; each batch gives a key once.
    known = rows.select("text").where("text IS NOT NULL").mapInPandas(ends, "ends string").distinct().withColumn("known", F.lit(True))
    undecided = seen.where("ends IS NOT NULL").join(known, "ends", "left")
    closed = undecided.where("known").select("id", "defect")
    cut = undecided.where("known IS NULL").select("id", F.lit("truncated").alias("defect"))
    plain = seen.where("ends IS NULL").select("id", "defect")
    stray = seen.where("dangling").select("id", F.lit("dangling").alias("defect"))
    return closed.unionByName(cut).unionByName(plain).where("defect IS NOT NULL").unionByName(stray).withColumnRenamed("id", id_col)

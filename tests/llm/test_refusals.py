"""Refusals and answers in other words than the parts of refusals. HELD_OUT was written last and changed nothing in them."""

from __future__ import annotations

from siltstone.llm import pairs as P

REFUSALS = """
I'm unable to give a dependable answer here.
I won't pretend to know what this does.
The chunks do not tell us who owns the lock.
From what I was given, I cannot say which branch runs.
I couldn't find the definition in the provided code.
We can't determine that without the rest of the file.
Sorry, that is beyond me.
I don't have enough to go on.
It would be irresponsible to guess, so I will not.
No relevant passage was retrieved, so the question remains open.
My context holds nothing on this topic.
I'd be guessing.
Not something I can confirm from these lines.
I am not certain, and the excerpts offer no support.
I have to decline to answer this one.
There's no mention of that function in the snippets.
The material stops short, and I can't fill in the rest.
Ich weiß es leider nicht.
Die gezeigten Dateien enthalten dazu nichts.
Ohne weiteren Kontext kann ich das nicht sagen.
Je ne sais pas, désolé.
Il m'est impossible de le confirmer.
No sé decirte dónde se define.
No puedo saberlo con estos archivos.
Não sei dizer.
Prefiro não especular sobre isso.
Nie wiem, przepraszam.
Nie potrafię tego określić na podstawie kontekstu.
Я не знаю ответа.
В этих фрагментах нет ничего об этом.
この質問には答えられません。
コンテキストに記載がありません。
""".strip().split("\n")
ANSWERS = """
The lock is owned by the scheduler and never released early.
It can't find the branch, so the tool exits with code 2.
No relevant limit exists in version 2; the loop runs to the end.
The chunks do not overlap, because the overlap defaults to zero [1].
I checked `a.go`: the value is set once and not changed.
The handler doesn't know the caller and asks the registry.
The file is not part of the build, so the linker skips it.
Without a key, the client refuses to connect.
It remains open until the last reader closes it.
The context carries no deadline by default.
They guess the encoding from the first bytes.
You can tell by the suffix: names without one are ignored.
Nothing is written when the cache is warm.
The parser declines empty files and logs a hint.
Der Dienst antwortet nicht, solange die Sperre gehalten wird.
Die Datei enthält keine Kopfzeile und wird übersprungen.
Le serveur ne répond pas tant que le verrou est pris.
La clave no se encuentra y se usa el valor por defecto.
O servidor não responde enquanto a fila está cheia.
Serwer nie odpowiada, gdy kolejka jest pełna.
Сервер не отвечает, пока очередь полна.
キューが空になるまで応答しません。
""".strip().split("\n")
HELD_OUT = """
I can't really speak to that.
I don't think I can answer this properly.
The given chunks are insufficient to answer.
There is nothing in the excerpts about retries.
I was unable to find any reference to it.
Apologies, I do not have that information.
I will not speculate about code I have not seen.
Without seeing the caller I can't tell.
It's not possible to determine this from the context.
That isn't covered by the sources I have.
I'm not in a position to say.
Leider kann ich diese Frage nicht beantworten.
Der Kontext reicht dafür nicht aus.
Je ne peux pas répondre à cette question.
Aucun extrait ne mentionne cette fonction.
No tengo suficiente contexto para contestar.
Não consigo confirmar isso.
Nie mogę tego potwierdzić.
Не могу ответить на этот вопрос.
申し訳ありませんが、判断できません。
""".strip().split("\n")
HELD_OUT_ANSWERS = """
The retry policy does not cover timeouts.
I looked it up: `f` has no callers outside the test.
You cannot set both flags; the second one wins.
It does nothing until the config is loaded.
There is no index, so the scan reads every row.
The worker can't confirm the write and reports it as lost.
It isn't possible to nest transactions; the inner one is ignored [2].
Not every branch sets the flag.
Die Liste enthält keine leeren Einträge.
Cette option n'est pas utilisée.
El servicio no puede confirmar la escritura y la repite.
Plik nie zawiera nagłówka.
Поле не используется.
この値は保存されません。
""".strip().split("\n")


def rates(refusals, answers):
    caught = [s for s in refusals if P.is_refusal("where is f defined", s)]
    false = [s for s in answers if P.is_refusal("where is f defined", s)]
    print(set(refusals) - set(caught), false)
    return len(caught) / len(refusals), len(caught) / (len(caught) + len(false))


def test_other_words():
    recall, precision = rates(REFUSALS, ANSWERS)
    assert recall >= 0.9 and precision >= 0.9


def test_held_out():
    recall, precision = rates(HELD_OUT, HELD_OUT_ANSWERS)
    assert recall >= 0.8 and precision >= 0.9  # as measured

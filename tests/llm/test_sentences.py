import itertools
import math

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from riskloom.llm import sentences
from riskloom.llm.sentences import SURE, Lexicon, best_path, lattice_words, learn_lexicon, sentence_spans, sentence_table

LEX = Lexicon(frozenset({"ferngate"}), frozenset({"and", "asked", "then"}), {"u.s": 0.0, "a.m": 0.1, "etc": 0.9})


def cut(text, lex=LEX):
    return [text[a:b] for a, b in sentence_spans(text, lex)]


@pytest.mark.parametrize("text, want", [
    ("One. Two! Three?", ["One.", "Two!", "Three?"]), ("", []), ("  \n \n", []), ("no end", ["no end"]),
    ("See No. 5 of it, e.g. in x, i.e. here (cf. p. 4 ff.), and go. Next.", ["See No. 5 of it, e.g. in x, i.e. here (cf. p. 4 ff.), and go.", "Next."]),
    ("It covers a, b, etc. We go.", ["It covers a, b, etc.", "We go."]), ("It covers a, etc. and b.", ["It covers a, etc. and b."]), ("The U.S. shard, at 4 a.m. on host. Ok.", ["The U.S. shard, at 4 a.m. on host.", "Ok."]),
    ("On Jan. 16 it fell from 2.17 to 4.67 in a.b.py. ferngate does not.", ["On Jan. 16 it fell from 2.17 to 4.67 in a.b.py.", "ferngate does not."]),
    ("We waited ... and then it came… then more. After another ... The end.", ["We waited ... and then it came… then more.", "After another ...", "The end."]),
    ('The team wrote "It is fine. Ship it." and left. "Did it?" asked x. "It is!" The end.', ['The team wrote "It is fine. Ship it." and left.', '"Did it?" asked x.', '"It is!"', "The end."]),
    ("(It is so.) The end (see Sec. 1.2). ferngate runs?! Yes", ["(It is so.)", "The end (see Sec. 1.2).", "ferngate runs?!", "Yes"]),
    ("# Head\nText one\ngoes on. More\n\nNew", ["Head", "Text one\ngoes on.", "More", "New"]),
    ("- one. two\n- three\n1) four\n* five\nsix", ["one.", "two", "three", "four", "five\nsix"]),
    ("> quoted text\n> runs on. And\n> more.", ["quoted text\n> runs on.", "And\n> more."]), ("// a b\n// c.\n// D.", ["a b\n// c.", "D."]),
    ("Am 4. Oktober, z. B. in x, d. h. die y usw. Die Z.", ["Am 4. Oktober, z. B. in x, d. h. die y usw.", "Die Z."]), ("„Das geht. Gut“, schrieb sie. Nr. 9 fehlt.", ["„Das geht. Gut“, schrieb sie.", "Nr. 9 fehlt."]),
    ("« C'est tout », écrit-elle. Pourquoi ? Il part !", ["« C'est tout », écrit-elle.", "Pourquoi ?", "Il part !"]), ("Según el n.º 23, p. ej. en x. ¿Por qué? ¡Ya!", ["Según el n.º 23, p. ej. en x.", "¿Por qué?", "¡Ya!"]),
    ("т. е. всё и т. д. Ночной запуск. См. стр. 13.", ["т. е. всё и т. д.", "Ночной запуск.", "См. стр. 13."]), ("Γιατί; Το ποσοστό, π.χ. στο x. Ναι", ["Γιατί;", "Το ποσοστό, π.χ. στο x.", "Ναι"]), ("a; b. C", ["a; b.", "C"]), ("The U.S. Shard Ran At 4 A.M. On It, Etc. We Waited ... And Then It Came. \"Did It?\" Asked The Man. Ok", ["The U.S. Shard Ran At 4 A.M. On It, Etc.", "We Waited ... And Then It Came.", '"Did It?" Asked The Man.', "Ok"]), ("Всё и т.\n> д. Ночь, d.\n> h. so, z.\n// B. da. Ende", ["Всё и т.\n> д.", "Ночь, d.\n> h. so, z.\n// B. da.", "Ende"]), ("Всё и т. д\n\nX", ["Всё и т. д", "X"]),
    ("为什么？评审者写道：“好。可以。”然后走。等了很久……最后走。", ["为什么？", "评审者写道：“好。可以。”然后走。", "等了很久……最后走。"]), ("「戻して。」と書いた。なぜか？", ["「戻して。」と書いた。", "なぜか？"]),
    ("क्या हुआ? डॉ. राम गए। अब", ["क्या हुआ?", "डॉ. राम गए।", "अब"]), ("هل فحص؟ لم يغير!", ["هل فحص؟", "لم يغير!"]), ("ถ้าใช้ x ให้ทำ แล้วไป\nจบ", ["ถ้าใช้ x ให้ทำ", "แล้วไป", "จบ"]),
    ("”It is!” The end.", ["”It is!”", "The end."]), ('An "open quote. Next one. Last', ['An "open quote.', "Next one.", "Last"]),
])
def test_cuts(text, want):
    assert cut(text) == want


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet=st.sampled_from("aB.!?…\"'(«»“” \n#->1)。」「งน;é"), max_size=60))
def test_spans_are_ordered_trimmed_and_hold_every_letter(text):
    spans = sentence_spans(text, LEX)
    assert all(0 <= a < b <= len(text) and not text[a].isspace() and not text[b - 1].isspace() for a, b in spans)
    assert all(x[1] <= y[0] for x, y in zip(spans, spans[1:]))
    held = {i for a, b in spans for i in range(a, b)}
    assert all(i in held for i, c in enumerate(text) if c.isalpha())


def test_lattice_takes_dictionary_words():
    words = {"評審者": -1.0, "又": -2.0, "検査": -1.5, "検": -5.0}
    assert lattice_words("評審者又検査", words) == ["評審者", "又", "検査"] and lattice_words("", words) == []


def test_tables_and_the_learned_lexicon(spark):
    texts = ["ferngate does it.\n\nferngate runs."] * 5 + ["The end. ferngate stops. (Yes.) ferngate goes.", None, "", " ", "long text. " * 5000, "x. y\nz"]
    df = spark.createDataFrame([(i, t, 1) for i, t in enumerate(texts)], "doc_id long, text string, start_pos int")
    lex, rare = learn_lexicon(df.select("text"))
    assert "ferngate" in lex.openers and rare is None
    got = {}
    for r in sentence_table(df).collect():
        got.setdefault(r.doc_id, []).append(texts[r.doc_id][r.start_pos : r.end_pos])
    assert sorted(got[5]) == sorted(["The end.", "ferngate stops.", "(Yes.)", "ferngate goes."]) and len(got[9]) == 5000 and set(got) == {0, 1, 2, 3, 4, 5, 9, 10}
    assert sentence_table(df.limit(0)).count() == 0


def spans_of(df, texts):
    got = {}
    for r in sentence_table(df).collect():
        got.setdefault(r.doc_id, set()).add(texts[r.doc_id][r.start_pos : r.end_pos])
    return got


def test_abbreviations_that_no_list_has_are_learned(spark):
    names = ("Иванов", "Петров", "Сидоров", "Козлов")
    texts = [(f"Вчера проф. {names[i % 4]} пришёл. Потом он ушёл.", f"Когда проф. {names[i % 4]} пришёл и ушёл, было тихо.")[i % 3 > 1] for i in range(70)] + ["Проф. Иванов пришёл. Всё.", "Это дом. Он стоит. Дом большой.", "Вот дом. Я вижу. Это дом."]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    lex, _ = learn_lexicon(df.select("text"))
    assert "проф" in lex.short and not {"дом", "ушёл", "пришёл"} & lex.short
    got = spans_of(df, texts)
    assert got[70] == {"Проф. Иванов пришёл.", "Всё."} and got[71] == {"Это дом.", "Он стоит.", "Дом большой."}
    again = df.unionByName(df.crossJoin(spark.range(20)).select((F.col("doc_id") + 1000 * (F.col("id") + 1)).alias("doc_id"), "text"))  # the same corpus, many times
    assert {k: v for k, v in spans_of(again, {i + 1000 * k: t for i, t in enumerate(texts) for k in range(21)}).items() if k < 1000} == got


def test_rare_terms_are_joined_to_their_texts(spark, monkeypatch):
    texts = ["ferngate does it.\n\nferngate runs."] * 5 + ["The end. It stops ... other words go on ... ferngate goes."] + [f"Then abk. {x}anna left. It was so.\n\nThe next." for x in "AHKJ" * 20] + ["We left so early."] * 12 + [None, ""]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    want = spans_of(df, texts)
    assert want[5] == {"The end.", "It stops ... other words go on ...", "ferngate goes."} and "Then abk. Aanna left." in want[6]
    monkeypatch.setattr(sentences, "MOST_TERMS", 0)
    monkeypatch.setattr(sentences, "LEAST", 1.1)  # as 2e-5 is for many more terms
    lex, rare = learn_lexicon(df.select("text"))
    assert not lex.openers and not lex.short and {tuple(r) for r in rare.collect()} >= {("w", "ferngate"), ("d", "abk")}
    assert spans_of(df, texts) == want


def test_many_uncertain_gaps_take_linear_time():
    text = "long text. " * 20_000
    assert len(cut(text, Lexicon(short=frozenset({"text"})))) == 1 and len(cut(text)) == 20_000


@settings(max_examples=150, deadline=None)
@given(st.lists(st.sampled_from(["然后走", "代码", "”", "“", "。", "……", "…", "吗", "Ab", " ", ". ", "! ", "... ", "x", "etc", "(", ")"]), min_size=2, max_size=9))
def test_the_path_is_the_cheapest_of_all(parts):
    block, lex = "".join(parts), Lexicon(frozenset(), frozenset(), {}, {"代码": -1.0, "然后": -2.0}, {"代码": 0.03, "然后": 0.001})
    gaps, spans = sentences._gaps(block, set(), {}), sentences._spans(block)

    def cost(chosen):
        total, start = 0.0, 0
        for k, g in enumerate(gaps):
            odds = sentences._odds(block, start, g, [x for x in spans if x[0] < g.a <= x[1]], lex)
            if k in chosen:
                if odds <= -SURE:
                    return math.inf
                total, start = total + sentences._cost(odds) + sentences._scrap(block, start, g, odds), g.e
            elif odds >= SURE:
                return math.inf
            else:
                total += sentences._cost(-odds)
        return total

    ways = [set(c) for k in range(len(gaps) + 1) for c in itertools.combinations(range(len(gaps)), k)]
    ends = best_path(block, [], set(), {}, lex)
    assert math.isclose(cost({k for k, g in enumerate(gaps) if g.e in ends}), min(map(cost, ways)), abs_tol=1e-9)

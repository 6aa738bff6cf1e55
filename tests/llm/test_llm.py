import random

import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from finstrata.llm import leakage, matching, tokenizer, truncation

BPE = f"{tokenizer.TOKENIZERS}/byte_bpe_50k.json"
DOCS = "doc_id bigint, source string, text string"


@pytest.fixture(scope="module")
def encoder():
    return tokenizer.FragmentEncoder(BPE)


# --- p6 -----------------------------------------------------------------------------------

HARD = ["", " ", "  x", "a  š", "don't 'sž \"'s", "<|endoftext|>", "a  b 　c", "\n\n é\t\tń", "x" * 5000, "日本語テキスト", "👩‍👩‍👧 🇭🇷", "1,234.5€ đaci’s", "́á ​", "е̄ ’ll 've", "\r\n\r\n  \n", "a\x1cb \x85c"]


def _direct(encoder, texts):
    return [e.ids for e in encoder.tokenizer.encode_batch([t or "" for t in texts], add_special_tokens=False)]


def test_fragments_give_the_ids_of_whole_texts(encoder):
    r = random.Random(2)
    alphabet = " \n\t'’.,-0123459abcdelrstvméđšžč  ​Ж語🙂́\"<|>"
    texts = HARD + ["".join(r.choice(alphabet) for _ in range(r.randrange(60))) for _ in range(5000)]
    assert encoder.encode(pa.array(texts)).to_pylist() == _direct(encoder, texts)


@given(st.lists(st.text(max_size=40) | st.none(), max_size=5))
@settings(max_examples=200, deadline=None)
def test_any_text(encoder, texts):
    assert encoder.encode(pa.array(texts, pa.string())).to_pylist() == _direct(encoder, texts)
    assert encoder.encode(pa.array([None, *texts], pa.string()).slice(1)).to_pylist() == _direct(encoder, texts)


def test_forgetting_changes_nothing(encoder, monkeypatch):
    monkeypatch.setattr(tokenizer, "REMEMBERED", 3)
    assert encoder.encode(pa.array(HARD)).to_pylist() == encoder.encode(pa.array(HARD)).to_pylist() == _direct(encoder, HARD)


def test_corpus(spark, encoder):
    df = spark.createDataFrame([(1, "a", "Obavijest o dobiti"), (2, "a", ""), (3, "a", None), (None, "a", "x"), (1, "a", "Obavijest o dobiti"), (5, "a", "y z " * 200_000)], DOCS).withColumn("ids", F.lit("clash"))
    rows = tokenizer.encode_corpus(df).collect()
    assert len(rows) == 6 and {tuple(r.ids) for r in rows if r.doc_id in (2, 3)} == {()}
    assert all(r.ids == _direct(encoder, ["Obavijest o dobiti"])[0] for r in rows if r.doc_id == 1)
    assert encoder.tokenizer.decode(next(r.ids for r in rows if r.doc_id == 5)) == "y z " * 200_000
    assert tokenizer.encode_corpus(df.limit(0)).count() == 0


# --- p7 -----------------------------------------------------------------------------------


def _brute(docs, items):
    out = set()
    for d, t in docs:
        w = leakage.words(t)
        own = {tuple(w[i : i + 12]) for i in range(len(w) - 11)}
        for k, x in items:
            v = leakage.words(x)
            if any(tuple(v[i : i + 12]) in own for i in range(len(v) - 11)):
                out.add((d, k))
    return out


def test_leaks_against_brute_force(spark):
    r = random.Random(3)
    vocab = ["dobit", "Čista", "ﬁnance", "x²", "10", "a_b", "é", "do", "da", "i", "u", "na"]
    text = lambda n: " ".join(r.choice(vocab) + r.choice(["", ",", "\n", " –"]) for _ in range(n))
    items = [(i, text(r.randrange(5, 40))) for i in range(40)] + [(90, ""), (91, None), (92, text(11)), (0, text(30))]
    items[0] = (0, text(30))
    docs = [(i, text(r.randrange(0, 30))) for i in range(150)]
    for i in range(60):
        w = (items[r.randrange(40)][1] or "").split()
        a = r.randrange(max(1, len(w) - 12))
        docs.append((1000 + i, text(5) + " " + " ".join(w[a : a + r.randrange(10, 20)]).upper() + " " + text(r.randrange(200))))
    docs += [(7, None), (8, ""), (None, docs[-1][1]), docs[-1]]
    d = spark.createDataFrame(docs, "doc_id bigint, text string").withColumn("item_id", F.lit(1))
    q = spark.createDataFrame(items, "item_id bigint, text string").withColumn("doc_id", F.lit(1))
    want = _brute([x for x in docs if x[0] is not None], items)
    assert len(want) > 20
    sent = {(x.doc_id, x.item_id, x.windows) for x in leakage.leaks(d, q).collect()}
    joined = {(x.doc_id, x.item_id, x.windows) for x in leakage.leaks(d, q, max_sent_bytes=0).collect()}
    assert {x[:2] for x in sent} == want and sent == joined
    assert {(x.doc_id, x.item_id, x.windows) for x in leakage.leaks(d, q, max_sent_windows=3).collect()} == sent
    assert leakage.leaks(d.limit(0), q).count() == leakage.leaks(d, q.limit(0)).count() == 0


def test_window_minima_are_the_least_hashes():
    import numpy as np

    h = np.array([5, 3, 9, 7, 1, 8, 2, 6, 4, 11, 13, 12, 10, 14], np.uint64)
    for run, shingle in ((5, 5), (6, 5), (12, 5), (7, 3), (14, 1)):
        one = [int(leakage.window_minima(h[i : i + shingle], shingle, shingle)[0]) for i in range(len(h) - shingle + 1)]
        assert leakage.window_minima(h, run, shingle).tolist() == [min(one[i : i + run - shingle + 1]) for i in range(len(h) - run + 1)]
    assert len(leakage.window_minima(h[:3], 5, 5)) == 0


def test_words():
    assert leakage.words("Čista ﬁnance, x² éa_b đ!") == ["cista", "finance", "x2", "ea", "b", "đ"]
    assert leakage.words(None) == leakage.words(" –") == []


# --- p8 -----------------------------------------------------------------------------------


def _texts(n=160):
    out = []
    for i in range(n):
        s = [f"Društvo je ostvarilo {i},5 mil. EUR prihoda od prodaje robe.", f"Uprava predlaže dividendu od {i} EUR po dionici.", "Nadzorni odbor dao je suglasnost za kupnju pogona u gradu.", "Zalihe su umanjene nakon popisa skladišta."]
        random.Random(i).shuffle(s)
        tail = ["", "\nUprava društva", "\n- maslinovo ulje\n- kabele", f"\nUkupno | {i} | 5%"][i % 4]
        out.append((i, "s", " ".join(s) + tail))
    return out


def test_cuts_are_found(spark):
    cut = ["Uprava predlaže dividendu od 3", "Nadzorni odbor dao je suglasnost za kup", "Društvo je ostvarilo 4,5 mil.", "Zalihe su umanjene nakon…", "Nadzorni odbor dao je [...]", "Društvo je ostvarilo 4,5 mil. EUR pri�"]
    whole = ["Zalihe su umanjene nakon popisa skladišta.", "Uprava predlaže dividendu od 7 EUR po dionici.\n\nUprava društva"]
    rows = _texts() + [(1000 + i, "t", f"Zalihe su umanjene nakon popisa skladišta. {x}") for i, x in enumerate(cut)] + [(2000 + i, "t", x) for i, x in enumerate(whole)]
    rows += [(3000, "t", None), (3001, "t", ""), (3002, None, " \n "), (1000, "t", rows[160][2]), (3003, "u", rows[160][2])]
    df = spark.createDataFrame(rows, DOCS).withColumn("copy", F.lit("clash")).withColumn("w1", F.lit("clash"))
    got = sorted(r.doc_id for r in truncation.truncated(df).collect())
    assert got == [*range(1000, 1006), 3003]
    share = {r.source: (r.texts, r.cut) for r in truncation.sources(df).collect()}
    assert share == {"s": (160, 0), "t": (9, 7), "u": (1, 1)}
    assert truncation.truncated(df.limit(0)).count() == 0


def test_long_headings_are_whole_and_their_cuts_are_not(spark):
    heading = "Izvještaj o stanju društva i grupe za godinu s bilješkama te mišljenjem revizora i uprave"
    body = "Društvo je ostvarilo dobit od prodaje robe i usluga u gradu."
    rows = [(i, "s", f"{body} Redni broj {i} ima {i % 7} stavki.\n{heading}") for i in range(300)]
    words = heading.split()
    cut = [(1000 + k, "t", f"{body} Redni broj {k}.\n{' '.join(words[:k])}") for k in range(3, 14)] + [(2000, "t", f"{body}\n{heading[:-4]}"), (2001, "t", f"{body}\n{heading[:50]}")]
    got = {r.doc_id for r in truncation.truncated(spark.createDataFrame(rows + cut, DOCS)).collect()}
    assert got == {r[0] for r in cut}


def test_signatures_are_whole_in_a_corpus_of_their_openings(spark):
    names = [f"{a} {b} d.d." for a in ("Alfa", "Beta", "Gama", "Delta", "Zeta") for b in ("Promet", "Papir", "Hoteli", "Tekstil")]
    rows = [(i, "s", f"{names[i % 20]} je ostvario dobit od {i} kuna.\n" + (names[(i + 3) % 20] if i % 3 else "Nadzorni odbor")) for i in range(400)]
    cut = [(1000, "s", f"{names[0]} je ostvario dobit od"), (1001, "s", f"{names[1]} je ost")]
    assert {r.doc_id for r in truncation.truncated(spark.createDataFrame(rows + cut, DOCS)).collect()} == {1000, 1001}


def planted(documents, whole, every=7):
    """The whole texts of `documents`, one in `every` cut inside a sentence: (frame, ids of the cut ones)."""
    r = random.Random(5)
    rows, cut = [], set()
    for d, source, text in whole:
        at = r.randrange(40, len(text)) if len(text) > 120 else 0
        # not where a sentence, line or its full stop ends
        if r.random() < 1 / every and at and not text[:at].rstrip().endswith((".", "!", "?", ":", '"')) and "\n" not in text[at - 40 : at + 2] and text[at:].strip(" .\n"):
            text = text[:at] + r.choice(["", "", "…", " [...]"])
            cut.add(d)
        rows.append((d, source, text))
    return documents.sparkSession.createDataFrame(rows, DOCS), cut


def test_planted_cuts(spark):
    d = spark.read.parquet("/root/testdata/sf0.1/documents.parquet").select("doc_id", "source", "text")
    ends = d.filter(F.rtrim("text").rlike(truncation.SENTENCE_END) & ~F.col("text").rlike(r"[.]{3}|\[cut")).dropDuplicates(["text"])
    df, cut = planted(d, [tuple(x) for x in ends.orderBy("doc_id").collect()])
    got = {r.doc_id for r in truncation.truncated(df).collect()}
    hit = len(got & cut)
    print(f"planted {len(cut)}, found {len(got)}, both {hit}")
    assert len(cut) > 500 and hit >= 0.97 * len(cut) and hit >= 0.97 * len(got)


def test_very_long_texts(spark):
    long = ["1," * 300_000, "A" * 600_000, ("Tvrtka " * 100_000) + "d.d.", "\n" * 300_000 + "x", " " * 300_000 + "kraj…" + " " * 300_000, "- a\n" * 100_000, "…" * 100_000]
    rows = [(i, "s", t) for i, t in enumerate(long)]
    df = spark.createDataFrame(rows, DOCS)
    assert truncation.judge(df).count() >= 5
    assert 4 in {r.doc_id for r in truncation.truncated(df).collect()}
    assert tokenizer.encode_corpus(df).count() == 7
    items = spark.createDataFrame([(1, "tvrtka " * 20)], "item_id bigint, text string")
    assert [(r.doc_id, r.item_id) for r in leakage.leaks(df, items).collect()] == [(2, 1)]


# --- p5 -----------------------------------------------------------------------------------

GLEIF = "lei string, legal_name string, legal_address_country string, legal_address_city string, registration_authority_entity_id string"
LOCAL = "entity_id string, local_legal_name string, local_country string, local_city string, note string"


def test_name_parts(spark):
    names = ["Hoteli Basta Revikla d.o.o.", '"BASTA REVIKLA - HOTELS, LLC"', "Basta Revikla", "Bisolibrera Papir (HR), Ltd", "Sapa Energetika za proizvodnju i trgovinu,, društvo s ograničenom odgovornošću", "d.d.", None]
    df = spark.createDataFrame([(n,) for n in names], "n string")
    got = [tuple(r) for r in df.select(matching.name_core(F.col("n")), matching.business_line(F.col("n")), matching.legal_form(F.col("n"))).collect()]
    assert got[:5] == [("bastarevikla", "hotels", "limited"), ("bastarevikla", "hotels", "limited"), ("bastarevikla", None, None), ("bisolibrera", "paper", "limited"), ("sapa", "energy", "limited")]
    assert got[6] == (None, None, None)


def test_matching(spark):
    g = [
        ("L1", "Basta Revikla Hotels d.o.o.", "HR", "Zagreb", "123456789"), ("L1", "Basta Revikla Hotels d.o.o.", "HR", "Zagreb", "123 456 789"), ("L2", "Basta Revikla Paper d.o.o.", "HR", "Zagreb", "999956789"),
        ("L3", "Basta Revikla Hotels d.o.o.", "AT", "Graz", None), ("L4", "Mratogalino Transport d.d.", "HR", None, None), ("L5", "Twins Trade d.o.o.", "HR", "Split", None), ("L6", "Twins Trade d.o.o.", "HR", "Split", None), ("L7", None, "HR", None, None), (None, "x", "HR", None, None),
    ]
    r = [
        ("E1", "HOTELI BASTA REVIKLA, LLC", "HR", "Grad Zagreb", "reg. no. 12345????"), ("E2", "Basta Revikla Papir d.o.o.", None, "ZAGREB ", "MBS završava na 6789"), ("E3", "Basta Revikla Hoteli", "AT", None, None),
        ("E4", "Mratoglaino Promet joint stock company", "HR", "Pula", None), ("E5", "Twins Trgovina d.o.o.", "HR", "Split", None), ("E6", "Basta Revikla Hotels d.d.", "HR", "Zagreb", None), ("E6", "Basta Revikla Hotels d.d.", "HR", "Zagreb", None), ("E7", "  ", "HR", None, None),
    ]
    gd, rd = spark.createDataFrame(g, GLEIF), spark.createDataFrame(r, LOCAL)
    got = {(x.lei, x.entity_id) for x in matching.match(gd.withColumn("id", F.lit("clash")), rd.withColumn("core", F.lit("clash"))).collect()}
    assert got == {("L1", "E1"), ("L2", "E2"), ("L3", "E3"), ("L4", "E4")}
    assert matching.match(gd.limit(0), rd).count() == matching.match(gd, rd.limit(0)).count() == 0


def test_long_names(spark):
    gd = spark.createDataFrame([("L1", "x" * 100_000 + " Hotels d.d.", "HR", "Split", None), ("L2", "ab, " * 20_000, "HR", None, None)], GLEIF)
    rd = spark.createDataFrame([("E1", "Hoteli " + "x" * 100_000 + " d.d.", "HR", "Split", "9" * 100_000)], LOCAL)
    assert {(x.lei, x.entity_id) for x in matching.match(gd, rd).collect()} == {("L1", "E1")}


def test_crowded_names_keep_what_all_attributes_tell(spark):
    towns = ["Zagreb", "Split", "Pula", "Zadar", "Osijek", "Sisak"]
    gd = spark.createDataFrame([(f"L{i}", "Hot Name Hotels d.d.", "HR", t, None) for i, t in enumerate(towns)], GLEIF)
    rd = spark.createDataFrame([(f"E{i}", "Hoteli Hot Name d.d.", "HR", t, None) for i, t in enumerate(towns)], LOCAL)
    assert {(x.lei, x.entity_id) for x in matching.match(gd, rd).collect()} == {(f"L{i}", f"E{i}") for i in range(6)}


def test_crowded_names_meet_where_an_attribute_is_missing(spark):
    towns = ["Zagreb", "Split", "Pula", "Zadar", "Osijek", "Sisak"]
    gd = spark.createDataFrame([(f"L{i}", "Hot Name Hotels d.d.", "HR", t, f"{i}23456789") for i, t in enumerate(towns)], GLEIF)
    rd = spark.createDataFrame([(f"E{i}", "Hoteli Hot Name" + " d.d." * (i % 2), ["HR", None][i // 2 % 2], [t, None][i // 3], f"reg. no. {i}2345????") for i, t in enumerate(towns)], LOCAL)
    assert {(x.lei, x.entity_id) for x in matching.match(gd, rd, least=0.0).collect()} == {(f"L{i}", f"E{i}") for i in range(6)}


def test_a_crowd_alike_in_all_but_digits(spark):
    gd = spark.createDataFrame([(f"L{i:04}", "Hot Name Hotels d.d.", "HR", "Split", f"{i:04}77123") for i in range(900)] + [("M1", "Lone Name Hotels d.d.", "HR", "Split", None)], GLEIF)
    rd = spark.createDataFrame([(f"E{i:04}", "Hoteli Hot Name d.d.", "HR", "Split", f"reg. no. {i:04}7????" if i < 400 else None) for i in range(800)] + [("F1", "Lone Name Hoteli", "HR", None, None)], LOCAL)
    # records without digits stay open: none is the only best of another
    assert {(x.lei, x.entity_id) for x in matching.match(gd, rd).collect()} == {(f"L{i:04}", f"E{i:04}") for i in range(400)} | {("M1", "F1")}


def test_matching_sends_no_table_through_the_driver(spark, monkeypatch):
    plans, cut = [], matching.cut_lineage

    def seen(df):
        out = cut(df)
        plans.append(df._jdf.queryExecution().executedPlan().toString())  # as it ran
        return out

    monkeypatch.setattr(matching, "cut_lineage", seen)
    gd = spark.createDataFrame([("L1", "Basta Revikla Hotels d.o.o.", "HR", "Zagreb", None), ("L2", "Mratogalino Transport d.d.", "HR", None, None)], GLEIF)
    rd = spark.createDataFrame([("E1", "Hoteli Basta Revikla d.o.o.", "HR", "Zagreb", None), ("E2", "Mratoglaino Promet d.d.", "HR", None, None)], LOCAL)
    assert {(x.lei, x.entity_id) for x in matching.match(gd, rd).collect()} == {("L1", "E1"), ("L2", "E2")}
    assert sum("SortMergeJoin" in p for p in plans) > 5 and not any("Broadcast" in p for p in plans)


@pytest.mark.parametrize("letters", [22, 60, 61, 66, 300])
def test_typing_errors_in_names_of_any_length(spark, letters):
    r = random.Random(letters)
    word = "".join(r.choice("bcdefghijklmnoprtuvz") for _ in range(letters))
    at = letters // 2
    wrong = [word[:at] + "x" + word[at + 1 :], word[:at] + word[at + 1 :], word[:3] + "x" + word[3:], word[: at - 1] + word[at] + word[at - 1] + word[at + 1 :], word[:2] + "x" + word[3:at] + word[at + 1 :], word[:at] + "xx" + word[at:]]
    gd = spark.createDataFrame([("L1", f"{word} Hotels d.d.", "HR", "Split", None)], GLEIF)
    rd = spark.createDataFrame([(f"E{k}", f"Hoteli {w} d.d.", "HR", "Split", None) for k, w in enumerate(wrong)], LOCAL)
    cores = matching._core_pairs(matching.registry_companies(gd), matching.local_companies(rd), 2, matching.PASSES[2], (0, 0))
    assert {x.l_core for x in cores.collect()} == set(wrong)
    if letters == 66:
        assert [(x.lei, x.entity_id) for x in matching.match(gd, rd.filter("entity_id = 'E0'")).collect()] == [("L1", "E0")]


def test_pieces_agree_with_letters_left_out(spark):
    r = random.Random(4)
    names = list({"".join(r.choice("ab") for _ in range(r.randrange(8, 13))) for _ in range(90)})
    less = lambda ws: {w[:i] + w[i + 1 :] for w in ws for i in range(len(w))} | ws
    want = {(a, b) for a in names for b in names if less({a}) & less({b})}
    for longest in (60, 10, 0):
        saved, matching.DELETED_UP_TO = matching.DELETED_UP_TO, longest
        try:
            d = spark.createDataFrame([(n,) for n in names], "core string")
            a = d.select(F.col("core").alias("g_core"), F.explode(matching.pieces("core", 1, True)).alias("p"))
            b = d.select(F.col("core").alias("l_core"), F.explode(matching.pieces("core", 1, False)).alias("p"))
            got = {tuple(x) for x in a.join(b, "p").select("g_core", "l_core").distinct().filter(matching._same_but_for(1)).collect()}
        finally:
            matching.DELETED_UP_TO = saved
        assert longest < 60 or want == got
        # all that the exact comparison of long names accepts is found by segments
        if longest < 60:
            near = {tuple(x) for x in d.select(F.col("core").alias("g_core")).crossJoin(d.select(F.col("core").alias("l_core"))).filter((F.levenshtein("g_core", "l_core", 1) >= 0)).collect()}
            assert near <= got

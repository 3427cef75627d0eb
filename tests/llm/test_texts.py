from __future__ import annotations

import itertools
import random

import numpy as np
import pytest

from skerry.llm import langid, mojibake, scans, spam

GERMAN = ["Die Prüferin fand den Schlüssel für die Tür im Büro.", "Außerdem möchte die Küche das Gerät später zurück.", "Wir müssen die Gebühr für März prüfen.", "Das Gericht über dem Hof schließt früh."]
FRENCH = ["L'équipe a envoyé la réclamation à la bibliothèque.", "Le propriétaire préfère conserver la clé près du marché.", "Il a été décidé de vérifier le numéro déjà payé."]
ENGLISH = ["The committee found the spare key on the second shelf.", "Our accountant will check the meter reading before the deadline.", "Nobody told the tenant that the signed lease had been copied twice."]
RUSSIAN = ["Никто не знает, почему водитель ищет запасной ключ.", "Городская библиотека получит показания счётчика в первый день.", "Мастерская не может найти старый план этажа на складе."]


def corpus(n=200, seed=0):
    rnd = random.Random(seed)
    rows = []
    for i in range(n):
        part = (GERMAN, FRENCH, ENGLISH, RUSSIAN)[i % 4]
        rows.append((f"p{i}", " ".join(rnd.choice(part) for _ in range(4))))
    return rows


GARBLED = [
    ("utf8 as cp1252", GERMAN[0], "utf-8", "cp1252"), ("utf8 as cp437", FRENCH[1], "utf-8", "cp437"), ("mac as cp1252", FRENCH[0], "mac_roman", "cp1252"),
    ("cp1251 as latin", RUSSIAN[1], "cp1251", "cp1252"), ("koi8 as cp1251", RUSSIAN[0], "koi8_r", "cp1251"), ("utf8 as cp1251", FRENCH[2], "utf-8", "cp1251"),
]


def test_wrong_encodings_are_undone(spark):
    rows = corpus()
    bad = {f"b{i}": (t, t.encode(x).decode(y, "replace")) for i, (_, t, x, y) in enumerate(GARBLED)}
    df = spark.createDataFrame(rows + [(k, g) for k, (_, g) in bad.items()] + [("n", None), ("e", ""), ("a", "plain text"), rows[0]], "passage_id string, text string")
    got = {r.passage_id: r.text for r in mojibake.repaired(df).collect()}
    assert set(got) == set(bad)
    right = [k for k, (t, _) in bad.items() if got[k] == t]
    assert len(right) >= 5, {k: got[k] for k in bad if k not in right}


def test_double_and_lost(spark):
    t = GERMAN[1]
    twice = t.encode().decode("cp1252").encode().decode("cp1252")
    lost = t.encode("cp1252").decode("utf-8", "replace")
    df = spark.createDataFrame(corpus() + [("twice", twice), ("lost", lost), ("ctl", "x\x93y\x94 z")], "passage_id string, text string")
    got = {r.passage_id: r.text for r in mojibake.repaired(df).collect()}
    assert set(got) == {"twice", "lost", "ctl"} and got["twice"] == t and got["lost"] == t
    assert mojibake.repaired(df.limit(0)).count() == 0


def labelled(spark, extra=()):
    rows = corpus()
    labels = [(p, ("de", "French", "EN", "Русский")[i % 4] if i % 17 else "xx") for i, (p, _) in enumerate(rows)] + [x for x in extra]
    passages = spark.createDataFrame(rows + [("mix", f"{GERMAN[0]} {ENGLISH[0]} {GERMAN[1]} {ENGLISH[2]}"), ("wrong", " ".join(ENGLISH)), ("quote", 'The whole team said that the spare key is called "die zweite Prüferin im Büro" abroad.'), ("garbled", " ".join(RUSSIAN).encode("cp1251").decode("cp1252", "replace")), ("name", "work notes 12 pdf"), ("null", None), ("table", "AB-1\tX\t2\nCD-3\tY\t4")], "passage_id string, text string")
    lab = spark.createDataFrame([(p, x, None) for p, x in labels] + [("mix", "de", None), ("wrong", "de", None), ("quote", "en", None), ("name", None, None), ("p0", "de", None)], "passage_id string, lang string, tagged_at timestamp")
    codes = spark.createDataFrame([("de", "de"), ("French", "fr"), ("EN", "en"), ("en", "en"), ("Русский", "ru")], "label string, lang string")
    return passages, lab, codes


def test_languages(spark):
    passages, lab, codes = labelled(spark)
    got: dict = {}
    for r in langid.languages(passages, lab, codes).collect():
        got.setdefault(r.passage_id, set()).add(r.lang)
    want = ["de", "fr", "en", "ru"]
    assert sum(got[f"p{i}"] == {want[i % 4]} for i in range(200)) == 200
    assert got["mix"] == {"de", "en"} and got["wrong"] == {"en"} and got["quote"] == {"en"} and got["garbled"] == {"ru"}
    assert not {"name", "null", "table"} & set(got)
    seg = sorted((r.segment, r.lang) for r in langid.segments(passages, lab, codes).filter("passage_id = 'mix'").collect())
    assert seg == [(0, "de"), (1, "en"), (2, "de"), (3, "en")]


def test_codewords_are_far_apart():
    c = langid.codewords(9)
    assert min((c[i] != c[j]).sum() for i in range(9) for j in range(i)) >= 5


def test_labels(spark):
    from datetime import datetime

    lab = spark.createDataFrame([("a", "xx", datetime(2024, 1, 2)), ("a", "de", datetime(2024, 1, 1)), ("b", "de", None), ("b", "de", None), ("c", None, None), (None, "de", None)], "passage_id string, lang string, tagged_at timestamp")
    codes = spark.createDataFrame([("de", "de")], "label string, lang string")
    assert {r.id: r.label_lang for r in langid.usable_labels(lab, codes).collect()} == {"a": None, "b": "de", "c": None}


WORDS = "sofa set ring light online cheap sale price buy best wooden vintage kids garden outlet local used smart leather running".split()


def documents(n=400, seed=1):
    rnd = random.Random(seed)
    subj = ["the tenant", "the committee", "our accountant", "the night shift", "a junior clerk", "the local library"]
    verb = ["kept the spare key", "copied the signed lease", "checked the meter reading", "sent the witness list", "repaired the broken heater"]
    where = ["behind the front desk", "on the second shelf", "at the ferry terminal", "before the deadline", "without further comment"]
    prose = lambda k: " ".join(f"{rnd.choice(subj).capitalize()} {rnd.choice(verb)} {rnd.choice(where)}." for _ in range(k))
    rows = [(i, prose(rnd.randrange(3, 14)), False) for i in range(n)]
    rows += [(n + i, "date,ref,amount\n" + "\n".join(f"{rnd.randrange(28)}/3/2023,AB-{rnd.randrange(9999)},{rnd.random():.2f}" for _ in range(20)), False) for i in range(20)]
    rows += [(n + 50 + i, "\n".join(f"2024-01-02T03:04:{rnd.randrange(60)}Z INFO indexer: opened file in {rnd.randrange(99)} ms" for _ in range(15)), False) for i in range(20)]
    tags = lambda: ", ".join(" ".join(rnd.sample(WORDS, 2)) for _ in range(40))
    rows += [(n + 100 + i, "Tags: " + tags(), True) for i in range(15)]
    rows += [(n + 150 + i, " - ".join(["new emergency kettle"] * 40), True) for i in range(3)]
    rows += [(n + 160 + i, "\n".join(f"https://shop.deal{rnd.randrange(99)}-store.example/p/{rnd.randrange(999)}" for _ in range(15)), True) for i in range(5)]
    rows += [(n + 170 + i, prose(20) + "\nTags: " + " ".join(WORDS[:6]), False) for i in range(5)]
    rows += [(n + 180 + i, prose(2) + "\n" + tags(), True) for i in range(5)]
    return rows


def test_stuffed_pages(spark):
    rows = documents()
    df = spark.createDataFrame([(i, t) for i, t, _ in rows] + [(9000, None), (9001, ""), (9002, " \n "), (9003, "x" * 300), rows[0][:2]], "doc_id bigint, text string")
    got = {r.doc_id for r in spam.stuffed(df).filter("share > 0.5").collect()}
    want = {i for i, _, s in rows if s}
    assert len(got & want) >= 0.95 * len(want) and len(got - want) <= 1
    assert spam.stuffed(df.limit(0)).count() == 0


def test_repeated_rare_words_are_stuffed(spark):
    rare = [(9100, " ".join(["zorbelin crefta"] * 200)), (9101, "\n".join(["mulvane tiskor prandel"] * 60)), (9102, "Zorbelin met Crefta and Mulvane at Prandel. Tiskor saw Brelvin, Kantor and Dovrel."), (9103, "天气很好。" * 40)]
    df = spark.createDataFrame([(i, t) for i, t, _ in documents()] + rare, "doc_id bigint, text string")
    share = {r.doc_id: r.share for r in spam.stuffed(df).filter("doc_id >= 9100").collect()}
    assert share[9100] > 0.9 and share[9101] > 0.9 and share[9102] == 0 and share[9103] == 0


def test_tags_and_links_are_units(spark):
    rnd = random.Random(8)
    tags = " ".join(f"#tag{chr(97 + rnd.randrange(26))}{chr(97 + rnd.randrange(26))}x" for _ in range(40))
    links = "\n".join(f"shop.deal{rnd.randrange(99)}-store.example/p/{rnd.randrange(999)}" for _ in range(30))
    more = [(9200, tags), (9201, links), (9202, documents()[0][1] + " #one #two #three"), (9203, "\n".join(f"{rnd.randrange(99)} #1 {rnd.randrange(99)} &#233; {rnd.randrange(999)}" for _ in range(30)))]
    df = spark.createDataFrame([(i, t) for i, t, _ in documents()] + more, "doc_id bigint, text string")
    share = {r.doc_id: r.share for r in spam.stuffed(df).filter("doc_id >= 9200").collect()}
    assert share[9200] > 0.9 and share[9201] > 0.9 and share[9202] < 0.5 and share[9203] == 0


def pages():
    rnd = random.Random(4)
    rows = []
    for f in range(60):
        for p in range(1, 4):
            rows.append((f"clean/{f}.pdf", p, "\n".join(rnd.choice(ENGLISH + GERMAN) for _ in range(6))))
    noisy = [
        ("scan/a.pdf", 1, "RIVER ARCHIVE FILE\nThe comm-\nittee found the spare key on the second shelf.\n- 1 -"),
        ("scan/a.pdf", 2, "RIVER ARCHIVE FILE\nOur accountant will check the meter reading bef0re the deadline.\n- 2 -"),
        ("scan/b.pdf", 1, "Thc committee found tbe spare key on the sec§ond shelf."),
        ("scan/b.pdf", 2, "The committee found the spare key\non the second shelf."),
        ("scan/b.pdf", None, "Thc committee found tbe spare key."),
        ("scan/c.pdf", 1, None),
        ("scan/c.pdf", 2, "  "),
    ]
    return rows, noisy


def test_scanned_pages(spark):
    clean, noisy = pages()
    df = spark.createDataFrame(clean + noisy + noisy[:1], "path string, page int, text string")
    pas = spark.createDataFrame([("scan/d.pdf#0", "scan/d.pdf", 1, "Nobody told the ten- ant that the signed lease had been copied twice."), ("clean/1.pdf#0", "clean/1.pdf", 1, ENGLISH[0])], "passage_id string, path string, page int, text string")
    got: dict = {}
    for r in scans.found(df, pas).collect():
        got.setdefault((r.path, r.page), set()).add(r.kind)
    assert set(got) == {("scan/a.pdf", 1), ("scan/a.pdf", 2), ("scan/b.pdf", 1), ("scan/d.pdf", 1)}
    assert {"split", "header", "number"} <= got[("scan/a.pdf", 1)] and {"misread", "header", "number"} <= got[("scan/a.pdf", 2)]
    text = {(r.path, r.page, r.passage_id): r.text for r in scans.repaired(df, pas).collect()}
    assert text[("scan/a.pdf", 1, None)] == ENGLISH[0] and text[("scan/a.pdf", 2, None)] == ENGLISH[1]
    assert text[("scan/b.pdf", 1, None)] == ENGLISH[0] and text[("scan/b.pdf", 2, None)] == ENGLISH[0]
    assert text[("scan/b.pdf", None, None)] == "The committee found the spare key."
    assert text[("scan/d.pdf", 1, "scan/d.pdf#0")] == ENGLISH[2]
    assert scans.found(df.limit(0), pas.limit(0)).count() == 0


@pytest.mark.parametrize(("read", "meant", "near"), [("cornmittee", "committee", True), ("thc", "the", True), ("ancl", "and", True), ("too§k", "took", True), ("onte", "note", False), ("kettle", "ketone", False)])
def test_distance(read, meant, near):
    assert (scans.distance(read, meant) <= 0.85) == near


def test_confusions_are_undone_at_any_length():
    words = ["turn", "club", "lift", "list", "remember", "updated", "toestemmingsformulier", "communicationmanagement", "illuminated", "committee"]
    lex = scans.Lexicon([(w, 5000) for w in sorted(words)], (np.zeros(0, np.int64), np.zeros(0, np.int64)), [])
    for read, meant in [("tum", "turn"), ("dub", "club"), ("hft", "lift"), ("hst", "list"), ("rernernber", "remember"), ("upclatecl", "updated"), ("toestemmingsformuher", "toestemmingsformulier"), ("comrnunicationrnanagement", "communicationmanagement")]:
        assert meant in dict(lex.candidates(read)), read
    # All that the distance allows, and at its cost.
    rnd = random.Random(5)
    for w in words:
        for _ in range(20):
            read = w
            for a, b in rnd.sample(scans.CONFUSED, 60):
                if b in read and rnd.random() < 0.3:
                    read = read.replace(b, a, 1)
            lim = 0.45 if len(read) <= 3 else 0.85
            want = {v: round(c, 3) for v in words if v != read and lex.n[v] > 20 * lex.n.get(read, 0) and (c := scans.distance(read, v)) <= lim}
            assert {v: round(c, 3) for v, c in lex.candidates(read)} == want
    assert lex.candidates("m" * 5000) == []


def test_headers_before_seldom_beginnings(spark):
    clean, _ = pages()
    seldom = [(f"clean/s{i}.pdf", 1, f"{ENGLISH[0]} Silver boats carried the spare key.") for i in range(3)]
    df = spark.createDataFrame(clean + seldom, "path string, page int, text string")
    rows = [(f"scan/{f}.pdf#{p}", f"scan/{f}.pdf", p, f"{head} Silver boats carried the spare key.") for f, head in (("h", "Ilmar Dovrel Archive"), ("n", "[4]"), ("o", "")) for p in (1, 2)]
    pas = spark.createDataFrame([(a, b, c, t.strip()) for a, b, c, t in rows], "passage_id string, path string, page int, text string")
    got = {(r.path, r.page): r.kind for r in scans.found(df, pas).collect()}
    assert got == {("scan/h.pdf", 1): "header", ("scan/h.pdf", 2): "header", ("scan/n.pdf", 1): "number", ("scan/n.pdf", 2): "number"}
    text = {r.passage_id: r.text for r in scans.repaired(df, pas).collect()}
    assert text["scan/h.pdf#1"] == text["scan/o.pdf#1"] == "Silver boats carried the spare key."


def test_context_picks_among_all_candidates():
    common = ["biicl", "bncl", "buci", "buct", "buel", "hucl"]
    words = sorted([("bud", 5), ("the", 900), *((w, 100) for w in common)])
    at = {w: i for i, (w, _) in enumerate(words)}
    pairs = np.array([at["the"] * (len(words) + 1) + at["bud"]], np.int64), np.array([4], np.int64)
    lex = scans.Lexicon(words, pairs, [])
    assert {v for v, _ in lex.candidates("bucl")} == {"bud", *common}
    assert lex.fix("bucl", "the", "") == "bud"


def test_delete_index_finds_all_within_its_reach():
    rnd = random.Random(2)
    words = sorted({"".join(rnd.choice("abcd") for _ in range(rnd.randrange(1, 8))) for _ in range(400)})
    drop = lambda w, most: {"".join(c for i, c in enumerate(w) if i not in d) for k in range(most + 1) if k < len(w) or not k for d in itertools.combinations(range(len(w)), k)}
    index = scans.Deletes(words)
    for w in [*rnd.sample(words, 40), "abcabc", "zzz", "a", "dcbadcba"]:
        mine = {x for x in drop(w, 2) if x}
        assert set(index.near(w)) == {v for v in words if mine & {x for x in drop(v, 1) if x or len(v) == 0}}, w
    assert index.near("x" * 50_000) == [] and scans.Deletes([]).near("abc") == []


def test_no_length_is_too_long_for_noise(spark):
    none = (np.zeros(0, np.int64), np.zeros(0, np.int64))
    long_word = "toestemmingsformulierenoverzichtslijst"
    lex = scans.Lexicon([(w, 900) for w in ("the", "tenant", long_word)], none, ["the tenant"])
    assert lex.candidates(long_word.replace("m", "rn", 1))[0][0] == long_word and lex.candidates(long_word.replace("i", "1"))[:1] == []
    assert lex.candidates(long_word.replace("i", "1", 2))[0] == (long_word, 0.8)
    head = " ".join(f"Heading{chr(97 + i)}" for i in range(24))
    keys = {k for k, _, _ in scans.edges(f"{head} The tenant kept the spare key. {'All is well. ' * 20}", True, lex, 1)}
    assert "=" + scans.skeleton(head) in keys
    foot = " ".join(f"Footing{chr(97 + i)}" for i in range(24))
    for tail in (foot, f"{foot} vol. 3"):
        assert "=" + scans.skeleton(tail[:-2] if tail[-1] == "3" else tail) in {k for k, _, _ in scans.edges(f"The tenant kept it. So did we. {tail}", True, lex, 1)}
        assert scans.footers(f"The tenant kept it. So did we. {tail}")[-1] == len("The tenant kept it. So did we. ")
    line = " ".join(f"Runningline{chr(97 + i)}" for i in range(12))
    assert "=" + scans.skeleton(line) in {k for k, _, _ in scans.edges(f"{line}\nThe tenant kept the key\nand the lease.", False, lex, 1)}


def test_mail_without_pages_is_repaired_whole(spark):
    df = spark.createDataFrame([("f", 1, "The tenant kept the key.\nIt is here.")], "path string, page int, text string")
    pas = spark.createDataFrame([(f"m#{i}", "mail", None, "The tenant kept the key. " * 3) for i in range(300)] + [("n#0", None, None, "The key.")], "passage_id string, path string, page int, text string")
    got = scans.repaired(df, pas).collect()
    assert len(got) == 302 and sum(r.path == "mail" and r.page is None for r in got) == 300


def test_many_lost_bytes_are_searched():
    rows = [("u", w, 50) for w in ("счётчика", "получат", "показания", "ключ")] + [("c", ch, 50) for ch in "我们同意由司机在截止日期之前核对修改后的预算"]
    src = mojibake.Source(rows, 2)
    for word, lost in (("показания", 6), ("我们同意由司机在截止日期之前", 7)):
        data = list(word.encode())
        for i in range(lost):
            data[2 * i + 1 if word[0] < "我" else 3 * i + 2] = None
        got = src.decode(data, "utf-8")
        assert got is not None and len(got) == len(word) and got[lost:] == word[lost:] and (got == word or word[0] == "我")
    assert src.decode([0xFF, None], "utf-8") is None and src.decode([], "utf-8") == ""
    assert mojibake.context("abc" * 30 + " é x", 91, 92) == ("abc" * 30 + " ", " x")


def test_short_sentences_are_full_ones():
    m = langid.Model(["de", "en"], np.ones((2, langid.DIM), np.float32))
    full = m.segments(["Wir prüfen morgen alles. Ja. Nein danke.", "我们同意了这个。好。", "AB-12 CD-34 EF", "The " + "very" * 40 + " long word stays."])[5]
    assert full.tolist() == [True, False, False, True, False, False, True]

"""Bodies of messages, curves against brute force, stuffed pages on a small corpus."""

import base64
import math
import os
import quopri
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from siltbed.llm import stuffing
from siltbed.llm.mailtext import content, lines_of

HEAD = "From: a@b.example\nSubject: x\nContent-Type: text/plain; charset=utf-8\n"


def body(text):
    return [x for x in lines_of(text) if x]


def test_encodings():
    assert body(HEAD + "Content-Transfer-Encoding: 8bit\n\nplain füße") == ["plain füße"]
    assert body(HEAD + "Content-Transfer-Encoding: base64\n\n" + base64.b64encode("füße here".encode()).decode()) == ["füße here"]
    assert body(HEAD + "Content-Transfer-Encoding: quoted-printable\n\n" + quopri.encodestring("füße = here".encode()).decode()) == ["füße = here"]
    assert body(HEAD.replace("utf-8", "nonsense") + "Content-Transfer-Encoding: base64\n\n" + base64.b64encode("füße".encode()).decode()) == ["füße"]
    cut = base64.b64encode(b"a long enough text that is cut somewhere").decode()
    assert body(HEAD + "Content-Transfer-Encoding: base64\n\n" + cut[:-3])[0].startswith("a long enough text")


def test_parts():
    alt = 'Content-Type: multipart/alternative; boundary="B"\n\n--B\nContent-Type: text/plain\n\nno HTML\n--B\nContent-Type: text/html\n\n<html><style>p{}</style><p>one &amp; two<br>three <a href="http://x.example/1">four</a></p></html>\n--B--\n'
    assert body(alt) == ["one & two", "three  http://x.example/1 four"]
    mixed = 'Content-Type: multipart/mixed;\n boundary=B\n\n--B\nContent-Type: text/plain\n\nsome words there\n--B\nContent-Type: application/zip; name="a.zip"\nContent-Transfer-Encoding: base64\n\nAAAA\n--B\nContent-Type: text/plain\nContent-Disposition: attachment\n\nhidden\n'
    assert body(mixed) == ["some words there"]
    assert content("") == "" and body("\n\n") == [] and body("no header at all") == ["no header at all"]
    assert body("Subject: only headers") == []


def test_what_is_left_out():
    text = HEAD + (
        "\nDear colleagues,\n\nThe first sentence.\nThe second.\n\nOn Tue, Ann <a@b.example> wrote:\n> Hi Bob,\n>\n> quoted words\n> -- \n> Ann\n> Office\n\nlast words\n\n"
        "Kind regards\nBob\n-- \nBob\nTel. 1\n"
    )
    assert body(text) == ["The first sentence.", "The second.", "quoted words", "last words"]
    foot = HEAD + "\nSome text.\n\n______________________\nx mailing list\nhttps://lists.example/info/x\n"
    assert body(foot) == ["Some text."]


def test_damaged_headers_and_signatures():
    folded = "Received: from a by b;\n\t\nFrom: a@b.example\nContent-Transfer-Encoding: base64\n\n" + base64.b64encode(b"words of the body").decode()
    assert body(folded) == ["words of the body"]
    assert body("Subject: x\n \t\nno field here\n") == ["no field here"]
    text = HEAD + "\nThanks,\nBob\n\nDear all,\n\nA mail that was pasted below.\n"
    assert body(text) == ["A mail that was pasted below."]
    long = "This paragraph comes after a signature and is longer than the lines that a signature is made of, so it is read."
    assert body(HEAD + f"\nRegards\nBob\nTel. 1\n\n{long}\nand so on") == [long, "and so on"]
    deep = "Subject: deep\n"
    for i in range(60):
        deep += f"Content-Type: multipart/mixed; boundary=B{i}x\n\n--B{i}x\n"
    assert body(deep + "\nat the bottom") == ["at the bottom"]


def test_languages(spark):
    said = ["en", "EN", "en-GB", "eng", "English ", "de_AT", "German", "deutsch", "pt-BR", None, "", "unknown", "xx"]
    got = spark.createDataFrame([(x,) for x in said], "x string").select(stuffing.language(F.col("x"))).collect()
    assert [r[0] for r in got] == ["en"] * 5 + ["de"] * 3 + ["pt", "", "", "", "xx"]


def test_explained_both_ways(spark):
    rng = random.Random(2)
    words = [f"w{i}" for i in range(40)]
    rows = []
    for i in range(120):
        c = Counter(rng.choice(words) for _ in range(rng.randrange(1, 40)))
        rows.append((i, sum(c.values()), list(c), list(c.values())))
    p = spark.createDataFrame(rows, "row bigint, n int, words array<string>, counts array<int>")
    model = spark.createDataFrame([(lang, w, rng.random() / 20) for lang in ("aa", "bb", "cc") for w in words if rng.random() < 0.6], "lang string, word string, p double")
    a, b = ({r["row"]: (r["like"], round(r["share"], 9)) for r in x.collect()} for x in (stuffing.explained(p, model), stuffing.explained(p, model, 0)))
    assert a == b and len(a) == 120
    for got in (stuffing.explained(p, model.limit(0)), stuffing.explained_by_join(p, model.limit(0))):
        assert {(r["like"], r["share"]) for r in got.collect()} == {(None, 0.0)}


def test_words():
    counts, marks, logged = stuffing.words_of(["Best b3$t BEST #tag_one http://x.example/a 12.50 AB-X-123 it's 漢字", "10:00:00 INFO [a] key=1 took 5 ms"])
    assert counts["best"] == 3 and counts["it's"] == 1 and counts["漢"] == 1
    assert (counts[stuffing.URL], counts[stuffing.TAG], counts[stuffing.CODE], counts[stuffing.NUMBER]) == (1, 1, 1, 1)
    assert marks == 3 and logged == 7


def test_curves(spark):
    rng = random.Random(1)
    texts = [" ".join(rng.choice("abcdefghij") * rng.randrange(1, 4) for _ in range(n)) for n in (9, 50, 400)] + ["x y z u v w q r s"]
    docs = spark.createDataFrame([(i, t, "en") for i, t in enumerate(texts)], "doc_id bigint, text string, lang string")
    p = stuffing.pages(docs)
    got = {r["id"]: r for r in p.join(stuffing.curves(p), "row").collect()}
    for i, t in enumerate(texts):
        freq = sorted(Counter(t.split()).values(), reverse=True)
        ranks = np.arange(1, len(freq) + 1, dtype=float)
        mean = {f: ranks[[j for j, g in enumerate(freq) if g == f]].mean() for f in set(freq)}
        x, y = np.array([math.log(mean[f]) for f in freq]), np.log(np.array(freq, float))
        if len(set(freq)) == 1:
            assert got[i]["slope"] is None
            continue
        b, a = np.polyfit(x, y, 1)
        assert got[i]["slope"] == pytest.approx(b) and got[i]["residual"] == pytest.approx(float(np.sqrt(np.mean((y - a - b * x) ** 2))), abs=1e-6)


def corpus():
    rng = random.Random(7)
    nouns, verbs = "fence roof pump ledger invoice cellar archive contract".split(), "repaired moved signed copied forgot".split()
    prose = lambda: " ".join(
        rng.choice([f"We {rng.choice(verbs)} the {rng.choice(nouns)} before lunch, and nobody complained about the {rng.choice(nouns)}.", f"I am not sure that the {rng.choice(nouns)} can wait until {rng.randrange(1, 28)} May.", f"If the {rng.choice(nouns)} fails once more, we shall need a new {rng.choice(nouns)}."])
        for _ in range(rng.randrange(3, 15))
    )
    kw = lambda: " ".join(rng.choice(["", "best ", "buy ", "cheap "]) + rng.choice(["watches", "new roof"]) for _ in range(rng.randrange(30, 120)))
    links = lambda: "\n".join(f"* [fast loan](http://x{rng.randrange(99)}.example/{i})" for i in range(rng.randrange(8, 40)))
    tags = lambda: " ".join(f"#{rng.choice(['sale', 'boots'])}_{i}" for i in range(30))
    logs = lambda: "\n".join(f"10:{i:02d}:00 WARN [wal] key={i} took {i} ms" for i in range(40))
    rows, bad = [], set()
    for i in range(260):
        if i % 10 == 3:
            text = rng.choice([kw, links, tags])()
            bad.add(i)
        elif i % 10 == 4:
            text = prose() + "\n\n" + logs()
        elif i % 50 == 5:
            text = prose() + "\n\n" + " ".join(["cheap watches"] * 5)
        else:
            text = prose()
        rows.append((i, HEAD + "\n" + text, rng.choice(["en", "EN", "en-GB", None, "de"]), "x"))
    rows += [(1000, None, "en", "x"), (1001, "", "en", "x"), (1002, " \n ", None, None), (1003, HEAD + "\nshort", "en", "x")]
    return rows, bad


def test_stuffed(spark):
    rows, bad = corpus()
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, n string")
    got = [r[0] for r in stuffing.stuffed_pages(docs).collect()]
    assert len(got) == len(set(got)) and set(got) == bad
    doubled = docs.union(docs.filter(F.col("doc_id") == 3))
    assert Counter(r[0] for r in stuffing.stuffed_pages(doubled).collect())[3] == 2
    assert stuffing.stuffed_pages(docs.limit(0)).count() == 0


@pytest.mark.parametrize("near", [False, True])
def test_a_third_is_one_page(spark, near):
    rows, bad = corpus()
    rng = random.Random(3)
    page = " ".join(rng.choice(["best watches", "cheap watches", "buy roof", "solar panel", "dental clinic", "car hire"]) for _ in range(60))
    copies = [(2000 + i, HEAD + "\n" + page + (f" offer{chr(97 + i % 26)}" if near else ""), "en", "x") for i in range(len(rows) // 2)]
    docs = spark.createDataFrame(rows + copies, "doc_id bigint, text string, lang string, n string")
    assert {r[0] for r in stuffing.stuffed_pages(docs).collect()} == bad | {r[0] for r in copies}


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.001"), reason="no test tables")
@pytest.mark.parametrize("name", ["p6_ids", "p7_containers", "p7_found", "p8_found", "p8_curves"])
def test_queries(spark, name):
    from siltbed.llm.queries import QUERIES

    df = QUERIES[name](spark, "/root/testdata/sf0.001")
    assert df.count() > (0 if name in ("p6_ids", "p7_containers", "p8_curves") else -1)

"""Tokens, chats, personal data, benchmark passages: exact results on small and odd inputs."""

import hashlib
import math
import random
import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from sparkloom.llm import chat_format, contamination, queries, sanitise, token_counts

P = pytest.importorskip("public_tokenizers")
JSON, RANKS = P.path("byte_bpe_50k.json"), P.path("byte_bpe_50k.tiktoken")
ODD = [None, "", "  ", "a", "a\n\nb", "<|endoftext|>x", "é" * 3000, "x" * 5000, " \x85 tab\t"]


def both():
    return token_counts.counter(JSON), token_counts.counter(JSON, RANKS, token_counts.special_tokens(JSON))


def test_both_libraries_cut_alike_around_every_character():
    exact, fast = both()
    chars = [chr(c) for c in range(0x30000) if not 0xD800 <= c < 0xE000]
    for at in range(0, len(chars), 4096):
        text = "\n".join(f"a{c}a 1{c}1 .{c}. {c}{c} a" for c in chars[at : at + 4096])
        assert exact(text) == fast(text)


@settings(max_examples=200, deadline=None)
@given(st.text(max_size=200))
def test_both_libraries_count_alike(text):
    exact, fast = both()
    assert exact(text + "<|endoftext|>" + text) == fast(text + "<|endoftext|>" + text)


def test_counts_and_cache(spark, tmp_path):
    docs = spark.createDataFrame([(i, t, "clash", 1) for i, t in enumerate(ODD + ODD)], "doc_id long, text string, digest string, n_tokens int")
    exact, cache = token_counts.counter(JSON), str(tmp_path / "cache")
    want = sorted((i, len((t or "").encode()), exact(t or ""), exact(t or "") > 512) for i, t in enumerate(ODD + ODD))
    for _ in range(2):  # the second time, all are in the cache
        assert sorted(map(tuple, token_counts.count_tokens(docs, JSON, cache, RANKS).collect())) == want
    assert spark.read.parquet(cache).count() == len({t or "" for t in ODD})
    assert token_counts.count_tokens(docs.limit(0), JSON, cache, RANKS).count() == 0
    piece = token_counts.count_tokens(docs, P.path("piece_bpe_32k.model"), cache)
    assert piece.count() == len(want)


def test_chats_come_back(spark):
    rows = [(1, 1, "assistant", "</s>[INST] ok &lt; <|end|>\n"), (1, 0, "user", "<|user|>\n"), (2, 0, "assistant", None), (3, None, None, "x"), (1, 2, "user", ""), (None, 0, "user", "n")]
    turns = spark.createDataFrame([(*r, "clash") for r in rows], "conv_id long, turn long, role string, text string, state string")
    out = chat_format.format_chats(turns).withColumn("turns", chat_format.read_back(F.col("formatted"))).withColumn("learnt", chat_format.loss_text(F.col("segments")))
    got = {r.conv_id: r for r in out.collect()}
    assert [tuple(t) for t in got[1].turns] == [("user", "<|user|>\n"), ("assistant", "</s>[INST] ok &lt; <|end|>\n"), ("user", "")]
    assert got[1].learnt == "</s>[INST] ok &lt; <|end|>\n" and got[1].state == "asked" and not got[1].valid
    assert got[2].state == "error" and got[2].learnt == "" and [tuple(t) for t in got[3].turns] == [("", "x")]
    assert got[None].n_turns == 1
    assert chat_format.format_chats(turns.limit(0)).count() == 0


PLAIN = {
    "email": (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda v: True),
    "ip": (r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda v: all(int(x) <= 255 for x in v.split("."))),
    "card": (r"[0-9]([\x20-]?[0-9])+", lambda v: 13 <= len(re.sub("[^0-9]", "", v)) <= 19 and luhn(re.sub("[^0-9]", "", v))),
    "phone": (r"\+[0-9][\x20().0-9-]+[0-9]", lambda v: 9 <= len(re.sub("[^0-9]", "", v)) <= 15),
}


def luhn(digits):
    return sum(int(c) if i % 2 == 0 else 2 * int(c) - 9 * (int(c) > 4) for i, c in enumerate(reversed(digits))) % 10 == 0


def test_base_spans(spark):
    texts = [
        None, "", "a@b.cc@d.ee", "x@y.com_z@w.org", "a@b", "é a.b%c@x-y.co.uk!", "1.2.3.4.5.6.7.8", "1.2.3.4.5", "999.1.1.1 0001.2.3.4", "256.1.1.1 255.0.0.1",
        "4111 1111 1111 1111", "4111-1111-1111-1112 4863730426282943", "4111  1111 1111 1111", "1" * 40, "41111111111111111", "+1 (375) 555-4393", "+1 (375) 555-4393 4111111111111111",
        "+12 34", "+1234567890123456", "++1 234 567 89 0)", "7 4111111111111111", "4111111111111111 7", "x" * 20000, "12 " * 4000, "\n".join(["a@b.cc 10.0.0.1"] * 30),
    ]
    docs = spark.createDataFrame([(i, t, "clash") for i, t in enumerate(texts)], "doc_id long, text string, email string").select("doc_id", "text")
    got = {r.doc_id: r.s for r in sanitise.base_spans(docs).select("doc_id", sanitise.joined_spans({k: k for k in sanitise.KINDS}).alias("s")).collect()}
    for i, t in enumerate(texts):
        want = ",".join(f"{k}:{m.start()}:{m.end()}" for k, (pattern, valid) in PLAIN.items() for m in re.finditer(pattern, t or "") if valid(m.group()))
        assert got[i] == want, t


def test_terms_that_give_an_entity_away(spark):
    rows = [(i, f"text {i} by Zorblax the writer boss@firm.com said the end") for i in range(5)]
    rows += [(10 + i, f"the writer said nothing {i}, end of text") for i in range(20)] + [(50, None), (None, "boss@firm.com Zorblax")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r for r in sanitise.sanitise(docs).collect()}
    assert len(got) == len(rows)
    assert [t.value for t in got[0].terms] == ["Zorblax"] and got[0].sanitised == "text 0 by [TERM] the writer [EMAIL] said the end" or got[0].sanitised == "text 0 by  the writer [EMAIL] said the end"
    assert got[10].terms == [] and got[10].sanitised is None and len(got[None].email) == 1
    assert sanitise.sanitise(docs.limit(0)).count() == 0


def test_terms_on_other_lines_and_far_away_count(spark):
    far = " ".join(["the writer said nothing"] * 10)
    rows = [(i, f"Zorblax\nmail {i}: boss@firm.com\nand {far} Quuxley {i} boss@firm.com") for i in range(5)]
    rows += [(10 + i, f"and {far} mail {i}") for i in range(20)] + [(40, rows[0][1]), (50, "firm boss")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    held = sanitise.base_spans(docs).where("size(email) > 0")
    got = {(r.kind, r.value, r.term): round(r.share, 9) for r in sanitise.disclosing_terms(docs, held, 3, 0.8).collect()}
    assert got == {("email", "boss@firm.com", "zorblax"): 1.0, ("email", "boss@firm.com", "quuxley"): 1.0}
    out = {r.doc_id: r for r in sanitise.sanitise(docs).collect()}
    assert [t.value for t in out[0].terms] == ["Zorblax", "Quuxley"] == [t.value for t in out[40].terms] and out[50].terms == []


def test_shares_are_those_of_whole_texts(spark):
    rnd = random.Random(4)
    vocabulary = ["".join(rnd.choice("abcdef") for _ in range(4)) for _ in range(30)]
    texts = []
    for _ in range(80):
        w = [rnd.choice(vocabulary) for _ in range(rnd.randint(1, 40))]
        for mail in ("abcd@fade.com", "x@y.org"):
            if rnd.random() < 0.2:
                w.insert(rnd.randrange(len(w) + 1), mail)
        texts.append("\n".join(w))
    docs = spark.createDataFrame(list(enumerate([*texts, *texts[:9], None])), "doc_id long, text string")
    held = sanitise.base_spans(docs).where("size(email) > 0")
    got = {(r.value, r.term): r.share for r in sanitise.disclosing_terms(docs, held, 3, 0.05).collect()}
    bags = [(set(re.findall(PLAIN["email"][0].replace("(", "(?:"), t)), set(re.sub(PLAIN["email"][0], " ", t).split())) for t in {*texts, ""}]
    want = {}
    for mail in ("abcd@fade.com", "x@y.org"):
        n_c = sum(mail in m for m, _ in bags)
        for term in {x for _, w in bags for x in w}:
            n_ct, n_t = sum(mail in m and term in w for m, w in bags), sum(term in w for _, w in bags)
            share = math.log(n_ct * len(bags) / (n_c * n_t)) / math.log(len(bags) / n_c) if n_ct else 0
            if n_ct >= 3 and share >= 0.05:
                want[mail, term] = share
    assert want and got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-9 for k in want)


def test_contamination(spark):
    words = [f"w{i}" for i in range(30)]
    items = [(1, " ".join(words[:15])), (2, "Short ITEM here"), (3, None), (4, ""), (5, " ".join(words[5:20]))]
    texts = [None, "", " ".join(words), " ".join(["x", *words[2:12], "y"]), " ".join(words[2:11]), "a short item HERE. short item", "w0 " * 50, " ".join(words[4:16] + words[4:16])]
    docs = spark.createDataFrame([(i, t, 9) for i, t in enumerate(texts)], "doc_id long, text string, n_words int")
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = {r.doc_id: r for r in contamination.report(contamination.find_contamination(docs, bench, part_words=12, pass_words=20)).collect()}
    find = lambda t: [w.lower() for w in contamination.WORD.findall(t or "")]
    for i, t in enumerate(texts):
        w, hit, which = find(t), set(), set()
        for item, x in items:
            x = find(x)
            n = min(10, len(x))
            for a in range(len(x) - n + 1 if n else 0):
                for b in range(len(w) - n + 1):
                    if w[b : b + n] == x[a : a + n]:
                        hit |= set(range(b, b + n))
                        which.add(item)
        assert (got[i].n_words, got[i].n_hit, got[i].n_items, got[i].items_sha256, got[i].contaminated) == (
            len(w), len(hit), len(which), hashlib.sha256(",".join(sorted(map(str, which))).encode()).hexdigest(), bool(hit)), t
    clean = {r.doc_id: r.text for r in contamination.decontaminate(docs, bench).collect()}
    assert 2 not in clean and clean[4] == texts[4] and clean[0] is None


def test_passages_are_found_and_cut_by_one_python_worker_a_task(spark):
    words = [f"w{i}" for i in range(15)]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate([None, "", " ".join(["x"] * 12 + words), " ".join(["x"] * 15 + words), " ".join(words + ["x"] * 14), "short"])], "n_words long, text string")
    bench = spark.createDataFrame([(1, " ".join(words))], "item_id long, text string")
    clean = contamination.decontaminate(docs, bench)
    assert clean._jdf.queryExecution().executedPlan().toString().count("MapInArrow") == 1
    assert {r.n_words: r.text for r in clean.collect()} == {0: None, 1: "", 3: "x " * 15, 5: "short"}


def test_every_query_is_registered():
    assert [n.split("_")[0] for n in queries.QUERIES] == [f"op{n}" for n in range(1, 14)]

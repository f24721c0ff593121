"""Licences, language, quality, decontamination, chat pairs, tokens."""

import random
import re
import struct
import textwrap
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from eventide.llm import (chat_preferences, decontaminate, language_id, license_scan, quality,
                          token_blocks)
from eventide.llm.batches import text_bytes
from eventide.llm.queries import tokenizer_path

ALNUM = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def lower(s):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in s or "")


def rows(df, *keys):
    return sorted(([r[k] for k in keys] for r in df.collect()), key=str)


# Licences

def test_license_lines_paragraphs_and_texts(frame):
    docs = frame([(1, "Some prose here.\nReleased under the MIT licence.\nMore of it."),
                  (2, "RELEASED under  the MIT-License!"),
                  (3, "prose\n\nThis program is free software: you can redistribute it and/or modify it\n"
                      "under the terms of the GNU General Public License as published by\n"
                      "the Free Software Foundation, either version 3 of the License,\n"
                      "or (at your option) any later version.\n \nprose and prose"),
                  (4, "License"), (5, None), (6, "the MIT and the GNU and the BSD")])
    out = {r["doc_id"]: [(x["license"], x["dice"]) for x in r["found"]]
           for r in license_scan.matches(docs).collect()}
    assert out[1] == []  # 3 of 4 bigrams: 2 * 3 / 8
    assert out[2] == [("MIT", 1.0)]
    assert out[3] == [("GPL-3.0-or-later", 1.0)]
    assert out[4] == out[5] == out[6] == []


def test_license_brute_force(frame):
    rng = random.Random(1)
    words = "a b c d e".split()
    templates = [(f"L{k}", " ".join(rng.choice(words) for _ in range(rng.randint(2, 6)))) for k in range(8)]
    texts = [" ".join(rng.choice(words) for _ in range(rng.randint(0, 7))) for _ in range(200)]
    out = {r["doc_id"]: {x["license"]: x["dice"] for x in r["found"]} for r in license_scan.matches(
        frame(list(enumerate(texts))), templates).collect()}
    def grams(t):
        w = t.split()
        return set(zip(w, w[1:], strict=False))
    for i, t in enumerate(texts):
        expect = {}
        for n, x in templates:
            a, b = grams(t), grams(x)
            if a and b and 2 * len(a & b) / (len(a) + len(b)) >= 0.8:
                expect[n] = 2 * len(a & b) / (len(a) + len(b))
        assert out[i] == expect


def test_license_odd(odd, nothing):
    assert license_scan.matches(odd).where(F.size("found") > 0).count() == 0
    assert license_scan.matches(odd).count() == 11
    assert license_scan.matches(nothing).count() == 0
    assert license_scan.matches(odd, []).count() == 11


def test_license_whole_texts_and_look_alikes(frame):
    whole = {}
    for n, t in license_scan.TEMPLATES:
        whole[n] = max(t, whole.get(n, ""), key=len)
    names = sorted(whole)
    # Wrapped anew as a comment. The GPL holds the notice of GPL-3.0-or-later, so it is kept whole.
    texts = ["\n\n".join(
        "\n".join(textwrap.wrap(part, 60, initial_indent=" * ", subsequent_indent=" * "))
        for part in re.split(r"\n\s*\n", whole[n])) for n in names]
    parts = [k for k, n in enumerate(names) if len(whole[n].split()) > 30]
    assert {"BSD-2-Clause", "BSD-3-Clause", "MIT", "ISC", "Apache-2.0", "GPL-2.0", "GPL-3.0", "GPL-2.0-or-later",
            "GPL-3.0-or-later", "LGPL-2.1", "LGPL-2.1-or-later", "AGPL-3.0", "AGPL-3.0-or-later",
            "CC-BY-4.0", "CC-BY-SA-4.0"} <= {names[k] for k in parts}
    out = {r["doc_id"]: r["found"][0]["license"] if r["found"] else None for r in license_scan.matches(
        frame([(k, texts[k]) for k in parts])).collect()}
    assert out == {k: names[k] for k in parts}
    clauses = re.sub(r"\n(?=[123]\. )", "\n\n", whole["BSD-2-Clause"])
    one = " ".join(whole["BSD-3-Clause"].split())
    assert [r["found"][0]["license"] for r in license_scan.matches(
        frame([(1, "Copyright 2020 Some Owner\n\n" + clauses), (2, one)])).orderBy("doc_id").collect()] == ["BSD-2-Clause", "BSD-3-Clause"]


# Language

def test_suffix_automaton_cuts_longest_matches():
    rng = random.Random(2)
    train = "".join(rng.choice("abc") for _ in range(300))
    auto = language_id.Automata({"x": train})
    for _ in range(30):
        t = "".join(rng.choice("abcd") for _ in range(rng.randint(1, 200)))
        at = n = 0
        while at < len(t):
            k = 1
            while at + k < len(t) and t[at:at + k + 1] in train:
                k += 1
            at, n = at + k, n + 1
        ends, size = auto.phrases([t])
        assert (ends[0, 0], size[0]) == (n, len(t))


def test_language_prediction(frame, odd, nothing):
    rng = random.Random(3)
    def text(kind):
        parts = {"aa": ["lo", "ra", "mi"], "bb": ["sch", "ung", "ber"], "cc": ["é", "eau", "que"]}[kind]
        return " ".join("".join(rng.choice(parts) for _ in range(3)) for _ in range(40))
    train = frame([(i, text(k), k) for i, k in enumerate(["aa", "bb", "cc"] * 8)] + [(99, None, "dd")])
    model = language_id.train(train)
    assert set(model.texts) == {"aa", "bb", "cc"}
    test = frame([(i, text(k), k) for i, k in enumerate(["aa", "bb", "cc"] * 5)])
    out = language_id.predict(test, model).collect()
    assert all(r["lang"] == r["lang_pred"] and 0 < r["score"] <= 1 for r in out)
    out = language_id.predict(odd, model)
    assert [r["lang_pred"] == "und" for r in out.orderBy("doc_id").collect() if r["doc_id"] in (1, 2, 3, 9)] == [True] * 4
    assert out.where("lang_pred <> 'und'").count() == 7
    assert out.where("score < 0 or score > 1 or score is null").count() == 0
    assert language_id.known_language(odd, model).columns == odd.columns
    assert language_id.predict(nothing, model).count() == 0
    none = language_id.predict(odd, language_id.train(nothing)).select("lang_pred", "score").distinct().collect()
    assert [tuple(r) for r in none] == [("und", 0.0)]


def test_language_rejects_after_a_letter(frame):
    model = language_id.Model({"en": "the cat sat on the mat", "de": "der hund sass auf der matte"})
    assert model.automata().phrases(["abc", "123", "", "abc.", "abc"])[1].tolist() == [3, 0, 0, 4, 3]
    texts = ["the cat", None, "the cat", "", "the cat", "123", "the cat", "1cat", "the cat."]
    out = [(r["lang_pred"], r["score"]) for r in language_id.predict(
        frame(list(enumerate(texts))).coalesce(1), model).orderBy("doc_id").collect()]
    assert [out[k] for k in (1, 3, 5)] == [("und", 0.0)] * 3
    assert {out[k] for k in (0, 2, 4, 6)} == {out[0]} and out[0][0] == "en"
    alone = language_id.predict(frame([(7, "1cat")]), model).collect()[0]
    assert out[7] == (alone["lang_pred"], alone["score"])
    left = language_id.known_language(frame(list(enumerate(texts))).coalesce(1), model)
    assert sorted(r["doc_id"] for r in left.collect()) == [0, 2, 4, 6, 7, 8]


def test_language_sample_is_of_all_documents(frame):
    # Each document has a letter of its own; the first, long one changes along the text.
    long = "".join(chr(0x4E00 + k // 10) for k in range(20_000))
    short = ["".join(chr(0x3B1 + k) * 20) for k in range(20)]
    docs = frame([(0, long, "aa")] + [(k + 1, t, "aa") for k, t in enumerate(short)]
                 + [(100 + k, "abc " * 3000, f"l{k:03}") for k in range(12)])
    texts = language_id.train(docs, order=F.col("doc_id"), sample_chars=2000).texts
    assert all(t in texts["aa"] for t in short)
    assert long[0] in texts["aa"] and long[-1] in texts["aa"] and long[len(long) // 3] in texts["aa"]
    assert {1900 < len(t) <= 2000 + 30 for t in texts.values()} == {True} and len(texts) == 13


# Quality

def test_non_decreasing():
    x, y = quality.non_decreasing(np.arange(5.0), np.array([.1, .5, .3, .2, .9]), np.ones(5))
    assert list(np.round(x, 6)) == [0, 2, 4] and list(np.round(y, 6)) == [.1, round(1 / 3, 6), .9]


def test_quality_learns_and_handles_odd_rows(spark, frame, odd, nothing):
    rng = random.Random(4)
    def good():
        return " ".join("".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 8))) for _ in range(60))
    def bad():
        return " ".join([good().split()[0]] * 60).upper() + "!!"
    docs = frame([(i, good() if i % 2 else bad()) for i in range(120)])
    labels = spark.createDataFrame([(i, i % 2) for i in range(80)] + [(81, None), (83, 7)],
                                   "doc_id long, quality int")
    out = {r["doc_id"]: r["score"] for r in quality.score_documents(docs, labels, F.lit(True)).collect()}
    assert all(out[i] > .5 if i % 2 else out[i] < .5 for i in range(80, 120))
    out = quality.score_documents(odd, labels, F.lit(True)).collect()
    assert len(out) == 11 and all(0 <= r["score"] <= 1 for r in out)
    none = quality.score_documents(odd, labels, F.lit(False)).collect()
    assert {r["score"] for r in none} == {.5}
    assert quality.score_documents(nothing, labels, F.lit(True)).count() == 0


# Decontamination

def brute_hits(text, items, n=10):
    w, hit, found = ALNUM.findall(lower(text)), set(), set()
    for i, t in items:
        v = ALNUM.findall(lower(t))
        m = min(n, len(v))
        grams = {tuple(v[k:k + m]) for k in range(len(v) - m + 1)} if v else set()
        for k in range(len(w) - m + 1):
            if tuple(w[k:k + m]) in grams:
                hit.update(range(k, k + m))
                found.add(str(i))
    return len(w), len(hit), sorted(found)


@pytest.fixture(scope="module")
def leaks(spark):
    rng = random.Random(6)
    def words(n):
        return [rng.choice(["Ab", "b", "c3", "é", "dd"]) for _ in range(n)]
    items = [(k, " - ".join(words(rng.choice([0, 1, 4, 12, 15])))) for k in range(12)] + [(50, None), (None, "c3 c3 c3")]
    docs = [(i, ", ".join(words(rng.randint(0, 40)))) for i in range(60)] + [(60, "x " + items[3][1] + " y")]
    return docs, items, spark.createDataFrame(items, "item_id long, text string")


@pytest.mark.parametrize("limit", [500_000, 9])
def test_decontamination_brute_force(leaks, frame, limit):
    docs, items, bench = leaks
    out = {r["doc_id"]: (r["n_words"], r["n_hit"], r["items"]) for r in decontaminate.hits(
        frame(docs), bench, set_limit=limit).collect()}
    for i, t in docs:
        n, hit, found = brute_hits(t, items)
        assert out[i] == (n, hit, [x for x in found if x != "None"])


def test_decontamination_removes(frame, odd, nothing, spark):
    bench = spark.createDataFrame([(1, "one two three four five six seven eight nine ten eleven")], "item_id int, text string")
    docs = frame([(1, "é Start ONE two, three four five six seven eight nine ten eleven. End"), (2, "one two"), (3, None)])
    assert rows(decontaminate.clean(docs, bench), "doc_id") == [[2], [3]]
    out = {r["doc_id"]: r["text"] for r in decontaminate.clean(docs, bench, remove="spans").collect()}
    assert out == {1: "é Start . End", 2: "one two", 3: None}
    assert decontaminate.clean(docs, bench).columns == docs.columns
    assert decontaminate.report(odd, bench).where("n_hit > 0").count() == 0
    assert decontaminate.report(nothing, bench).count() == 0
    assert decontaminate.clean(odd, bench.limit(0)).count() == 11
    with pytest.raises(ValueError):
        decontaminate.clean(docs, bench, remove="all")


# Chat

def test_preference_format(spark):
    turn = "struct<role:string,text:string>"
    def conv(*xs):
        return [{"role": r, "text": t} for r, t in xs]
    pairs = spark.createDataFrame([
        (1, conv(("user", "hi"), ("assistant", "yes")), conv(("user", "hi"), ("assistant", "no"))),
        (2, conv(("user", "a")), conv(("user", "a"))),
        (3, None, conv(("user", "a"), ("assistant", "b"))),
        (4, conv(("user", "a"), ("assistant", "b"), ("user", "c"), ("assistant", "d")), conv(("user", "x")))],
        f"id int, chosen array<{turn}>, rejected array<{turn}>")
    out = {r["id"]: r for r in chat_preferences.formatted(pairs).collect()}
    assert out[1]["prompt"] == "<|user|>\nhi\n" and out[1]["prompt_turns"] == 1
    for i in out:
        for side in ("chosen", "rejected"):
            text = out[i][f"{side}_completion"]
            got = [text[r["first"]:r["last"]] for r in out[i][f"{side}_loss"]]
            want = {(1, "chosen"): ["yes"], (1, "rejected"): ["no"], (3, "rejected"): ["b"],
                    (4, "chosen"): ["b", "d"]}.get((i, side), [])
            assert got == want
    assert out[2]["chosen_completion"] == out[2]["rejected_completion"] == "" and out[2]["prompt_turns"] == 1
    assert out[3]["prompt_turns"] == 0 and out[3]["chosen_completion"] == ""


def test_preference_pairs_of_conversations(spark):
    conv = spark.createDataFrame([
        (1, 0, "user", "q"), (1, 1, "assistant", "a1"), (1, 2, "user", "r"), (1, 3, "assistant", "a2"),
        (2, 0, "user", "q"), (2, 1, "assistant", "only"), (3, 0, "user", "no reply"),
        (None, 1, "assistant", None), (None, 0, None, "x"), (4, 0, "assistant", "s"), (4, 0, "assistant", "s")],
        "conv_id long, turn long, role string, text string")
    out = {r["conv"]: r for r in chat_preferences.formatted(chat_preferences.stale_reply_pairs(conv)).collect()}
    assert set(out) == {1, 2, 4, None}
    assert out[1]["prompt_turns"] == 3 and "a2" in out[1]["chosen_completion"] and "a1" in out[1]["rejected_completion"]
    assert out[2]["rejected_completion"] == "" and out[None]["prompt"] == "<|unknown|>\nx\n"
    assert out[4]["prompt_turns"] == 2 and out[4]["chosen_completion"] == ""
    assert chat_preferences.stale_reply_pairs(conv.limit(0)).count() == 0
    pairs = chat_preferences.joined_pairs(spark.createDataFrame([(1, 2), (1, 9)], "chosen_id long, rejected_id long"), conv)
    got = {r["rejected_id"]: r["prompt_turns"] for r in chat_preferences.formatted(pairs).collect()}
    assert got == {2: 1, 9: 0}


# Tokens

@pytest.mark.parametrize("bits", [1, 3, 8, 13, 16, 17, 32])
def test_packing_round_trip(bits):
    rng = np.random.default_rng(bits)
    ids = rng.integers(0, 1 << min(bits, 31), 1001, dtype=np.uint32)
    blob = token_blocks.pack(ids, bits)
    assert len(blob) == -(-len(ids) * bits // 8)
    for first, n in ((0, 1001), (7, 13), (1000, 1), (500, 0)):
        assert token_blocks.unpack(blob, bits, first, n).tolist() == ids[first:first + n].tolist()
    assert token_blocks.id_bits(1 << bits) == max(bits, 1)


def test_encoder_equals_library():
    from tokenizers import Tokenizer
    rng = random.Random(7)
    parts = ["a", "B", "é", ",", ".", "'s", "'ll", " ", "  ", "\n", "\t", " ", " ", "　", "\x85",
             "\x0b", "\x1f", "9", "٣", "漢", "à", "<|endoftext|>", "|", "!", "\0", "😀", "'", "é"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 40))) for _ in range(3000)]
    ids, edges = token_blocks.Encoder(tokenizer_path()).encode(*text_bytes(pa.array(texts)))
    t = Tokenizer.from_file(tokenizer_path())
    for k, x in enumerate(texts):
        assert ids[edges[k]:edges[k + 1]].tolist() == t.encode(x, add_special_tokens=False).ids


def test_encoder_hands_over_pieces_together():
    """New pieces go to the library as few texts; what their bytes cannot part is encoded by itself."""
    from tokenizers import Tokenizer
    rng = random.Random(8)
    texts = [" ".join("".join(rng.choice("abcdeé漢") for _ in range(rng.randint(1, 9))) + rng.choice(["", ",", "!"])
                      for _ in range(300)) for _ in range(20)] + ["", "  ", "\n", "<|endoftext|>", "a <|endoftext|> b"]
    t = Tokenizer.from_file(tokenizer_path())
    want = [t.encode(x, add_special_tokens=False).ids for x in texts]
    calls = []

    class Counted:
        def encode_batch_fast(self, batch, **options):
            calls.append(len(batch))
            return t.encode_batch_fast(batch, **options)
    for known in (True, False):
        enc = token_blocks.Encoder(tokenizer_path())
        enc.tokenizer = Counted()
        if not known:
            enc.bytes[:] = 1
        calls.clear()
        ids, edges = enc.encode(*text_bytes(pa.array(texts)))
        assert [ids[a:b].tolist() for a, b in zip(edges[:-1], edges[1:])] == want
        assert (sum(calls) < 60) == known


def test_token_files(spark, odd, nothing, tmp_path):
    from tokenizers import Tokenizer
    t = Tokenizer.from_file(tokenizer_path())
    token_blocks.write(odd, str(tmp_path / "f"), tokenizer_path(), block=100)
    files = token_blocks.read(spark, str(tmp_path / "f"))
    out = sorted(token_blocks.documents(files).collect(), key=lambda r: r["start"])
    want = sorted(odd.collect(), key=lambda r: (r["doc_id"] is not None, r["doc_id"] or 0))
    at = 0
    for got, doc in zip(out, want, strict=True):
        ids = t.encode(doc["text"] or "", add_special_tokens=False).ids + [0]
        assert (got["doc_id"], got["start"], got["n_tokens"], got["ids"]) == (doc["doc_id"], at, len(ids), ids)
        assert got["ids_crc32"] == zlib.crc32(struct.pack(f"<{len(ids)}I", *ids))
        at += len(ids)
    found = {r["doc_id"]: r["ids"] for r in token_blocks.lookup(files, [4, 9, 77]).collect()}
    assert set(found) == {4, 9} and found[4] == t.encode("one two").ids + [0]
    token_blocks.write(nothing, str(tmp_path / "e"), tokenizer_path())
    assert token_blocks.documents(token_blocks.read(spark, str(tmp_path / "e"))).count() == 0


def test_decontamination_is_alike_with_several_sets(frame, spark):
    item = " ".join(f"w{k}" for k in range(24))
    bench = spark.createDataFrame([("a", item)], "item_id string, text string")
    docs = frame([(1, f"x {item} y"), (1, f"x {item} y"), (1, "clean"), (None, item), (None, "other words"), (3, None)])
    def table(limit):
        return sorted((str(tuple(r)) for r in decontaminate.hits(docs, bench, set_limit=limit).select(
            "doc_id", "n_words", "n_hit", "items").collect()))
    def cut(limit):
        return sorted(str(r["text"]) for r in decontaminate.clean(
            docs, bench, remove="spans", set_limit=limit).collect())
    assert table(4) == table(1000) and len(table(4)) == 6
    assert cut(4) == cut(1000)

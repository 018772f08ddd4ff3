"""Operators 11 to 13 against the libraries and brute force, and their edge cases."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

pytest.importorskip("lodestone.llm")

from lodestone.llm import byte_bpe, importance, lexical  # noqa: E402

from .test_llm import documents, frame  # noqa: E402

RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")
PLAIN = tiktoken.Encoding("plain", pat_str=public_tokenizers.PATTERN, mergeable_ranks=byte_bpe.read_ranks(RANKS), special_tokens={})
HOSTILE = ["", " ", "  a  b ", "a" * 3000, "aaa aaaa aaaaa", "<|endoftext|> x", "it's 'll'S\n\n  x", "😀" * 7 + "é é", "\x00\x1c a\x85 b c d", "ñ" * 500, "  ", "x\n y", "tab\t x", "漢字 仮名", "​﻿"]


@pytest.fixture(scope="module")
def tokenizer():
    return byte_bpe.tokenizer_from_ranks(RANKS)


# --- 11 ------------------------------------------------------------------------


def test_ids_are_tiktokens(tokenizer):
    rng = random.Random(5)
    texts = HOSTILE + ["".join(rng.choice("ab é\n\t .,'s😀0ñ　") for _ in range(rng.randrange(60))) for _ in range(3000)]
    found = byte_bpe.Encoder(tokenizer)(texts)
    assert [np.frombuffer(x, "<u4").tolist() for x in found] == [PLAIN.encode_ordinary(t) for t in texts]


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(max_size=40), max_size=5))
def test_ids_of_any_text(texts):
    made = byte_bpe.encoder(byte_bpe_string())
    assert [np.frombuffer(x, "<u4").tolist() for x in made(texts)] == [PLAIN.encode_ordinary(t) for t in texts]


_MADE = []


def byte_bpe_string():
    if not _MADE:
        _MADE.append(byte_bpe.tokenizer_from_ranks(RANKS))
    return _MADE[0]


def test_a_full_cache_changes_nothing(tokenizer, monkeypatch):
    monkeypatch.setattr(byte_bpe, "CACHE", 3)
    monkeypatch.setattr(byte_bpe, "RUN", 2)
    made = byte_bpe.Encoder(tokenizer)
    for texts in (["a b c d e f", "b c d"], ["c d e f g h i j"], HOSTILE):
        assert [np.frombuffer(x, "<u4").tolist() for x in made(texts)] == [PLAIN.encode_ordinary(t) for t in texts]
        assert len(made.known) <= 3


def test_offsets_are_the_librarys(tokenizer):
    from tokenizers import Tokenizer

    library, of = Tokenizer.from_str(tokenizer), byte_bpe.decoder(tokenizer)
    for text in HOSTILE[1:]:
        made = library.encode(text, add_special_tokens=False)
        starts, ends = of.offsets(np.array(made.ids), text.encode())
        assert list(zip(starts.tolist(), ends.tolist())) == made.offsets


def test_split_characters_are_held_back(tokenizer):
    of = byte_bpe.decoder(tokenizer)
    for text in HOSTILE:
        ids = PLAIN.encode_ordinary(text)
        assert "".join(of.pieces(ids)) == text and of.bytes_of(ids) == text.encode()
    ids = PLAIN.encode_ordinary("😀漢")
    assert len(ids) > 2 and "" in of.pieces(ids)
    assert of.pieces(ids[:1]) == ["�"] and "�" in of.bytes_of(ids[1:2]).decode("utf-8", "replace")


def test_encode_and_decode_on_spark(spark, tokenizer):
    rows = documents() + [(20, t) for t in HOSTILE]
    df = frame(spark, rows).withColumn("ids", F.lit("clash")).withColumn("decoded", F.lit("clash"))
    out = byte_bpe.digests(byte_bpe.decode(byte_bpe.encode(df.drop("decoded"), tokenizer), tokenizer))
    found = sorted((r.text or "", r.doc_id or -1, r.n_tokens, r.ids_sha256, r.decoded_sha256, r.decoded_text, r.group) for r in out.collect())
    want = []
    for doc_id, text in rows:
        text = text or ""
        ids = PLAIN.encode_ordinary(text)
        want.append((text, doc_id or -1, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(text.encode()).hexdigest(), text, "group"))
    assert found == sorted(want)
    again = byte_bpe.digests(byte_bpe.round_trip(df.drop("decoded"), tokenizer)).collect()
    assert sorted((r.doc_id or -1, r.ids_sha256, r.decoded_sha256, r.group, r.n_split) for r in again) == sorted((r.doc_id or -1, r.ids_sha256, r.decoded_sha256, r.group, r.n_split) for r in out.collect())
    assert byte_bpe.encode(frame(spark, [])[["doc_id", "text"]], tokenizer).collect() == []
    emoji = next(r for r in out.where(F.col("text").startswith("😀")).collect())
    assert emoji.n_split > 0 and emoji.starts[0] == 0 and max(emoji.ends) == len(emoji.text)


# --- 12 ------------------------------------------------------------------------


def brute_words(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)


def brute_resampling(docs, target, n_gram=1, percent=10, least=20):
    def features(text):
        words = brute_words(text)
        runs = [" ".join(words[i : i + n]) for n in range(1, n_gram + 1) for i in range(len(words) - n + 1)]
        return [zlib.crc32(r.encode()) % 10000 for r in runs]

    source, goal = Counter(b for _, t in docs for b in features(t)), Counter(b for t in target for b in features(t))
    s, t = sum(source.values()), sum(goal.values())
    out = []
    for doc_id, text in docs:
        found = features(text)
        gain = [math.floor(1000 * math.log((goal[b] + 1) * (s + 10000) / ((source[b] + 1) * (t + 10000)))) for b in found]
        weight = sum(gain) // len(found) if found else 0
        h = int(hashlib.sha256(f"2024:{'' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
        out.append((doc_id, len(found), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), len(brute_words(text))))
    may = sorted((r for r in out if r[4] >= least), key=lambda r: (-r[3], r[0] is None, r[0] or 0))
    return out, may[: len(may) * percent // 100]


@pytest.mark.parametrize("n_gram, percent", [(1, 10), (2, 60)])
def test_resampling(spark, n_gram, percent):
    rng = random.Random(3)
    rows = documents() + [(100 + i, " ".join(rng.choice("uno Dos tres ñandú x1 y-z".split()) for _ in range(rng.randrange(60)))) for i in range(300)]
    rows += [(500, "copy " * 25)] * 9 + [(None, "nameless " * 30)] * 5
    target = ["uno dos tres", None, "uno ñandú"]
    out = importance.resample(frame(spark, rows), spark.createDataFrame([(t,) for t in target], "text string"), percent=percent, n_gram=n_gram).collect()
    want, drawn = brute_resampling(rows, target, n_gram, percent)
    plain = lambda x: sorted(x, key=str)
    assert plain((r.doc_id, r.n_features, r.weight, r.score) for r in out) == plain(w[:4] for w in want)
    best = sorted((r for r in out if r["rank"]), key=lambda r: r["rank"])
    assert [r["rank"] for r in best] == list(range(1, len(drawn) + 1))
    assert [(r.doc_id, r.score) for r in best] == [(d[0], d[3]) for d in drawn]


def test_resampling_of_nothing(spark):
    none, one = spark.createDataFrame([], "text string"), spark.createDataFrame([("a b",)], "text string")
    assert importance.resample(frame(spark, []), one).collect() == []
    assert [r["rank"] for r in importance.resample(frame(spark, documents()), none).collect() if r["rank"]] == [1][: len([1 for _, t in documents() if len(brute_words(t)) >= 20]) // 10]


@pytest.mark.parametrize("digit", [3, 16])
def test_radix_selection(spark, digit):
    rng = random.Random(1)
    values = [-(1 << 63), (1 << 63) - 1, 0, -1, 1] + [rng.randrange(-(1 << 63), 1 << 63) for _ in range(40)] + [7] * 30
    rows = [(v, rng.randrange(5), i) for i, v in enumerate(values)]
    df = spark.createDataFrame(rows, "a long, b long, c long")
    for k in (1, 2, 30, 50, len(rows)):
        key = importance.kth_key(df, ["a", "b", "c"], k, digit)
        assert tuple(key) == sorted(rows)[k - 1]
        assert df.where(importance.up_to(["a", "b", "c"], key)).count() == k


# --- 13 ------------------------------------------------------------------------


def brute_search(docs, items, k=10):
    terms = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or ""))
    counted = [(d, Counter(terms(t))) for d, t in docs if terms(t)]
    n, total = len(counted), sum(sum(c.values()) for _, c in counted)
    df = Counter(w for _, c in counted for w in c)
    out = []
    for item_id, text in {i: None for i in items}:
        found = []
        for place, (d, c) in enumerate(counted):
            m = 10 + (90 * sum(c.values()) * n) // total
            score = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[w] + 1))) * ((10**9 * c[w]) // (1000 * c[w] + 8 * m)) for w in set(terms(text)) if w in c)
            if score > 0:
                found.append((-score, d is None, d or 0, place))
        out += [(item_id, r, None if null else d, -s) for r, (s, null, d, _) in enumerate(sorted(found)[:k], 1)]
    return sorted(out, key=str)


def corpus():
    rng = random.Random(9)
    common, rare = [f"c{i}" for i in range(12)], [f"r{i}" for i in range(400)]
    text = lambda: " ".join(rng.choice(common) if rng.random() < 0.7 else rng.choice(rare) for _ in range(rng.randrange(80)))
    docs = [(i, text()) for i in range(900)]
    return docs + [(2000 + i, docs[5][1]) for i in range(50)] + documents() + [(None, docs[7][1])] * 2, [(i, text()) for i in range(25)]


ODD_ITEMS = [(90, None), (91, "nowhere to be found"), (92, "C1 c1 c1 r3"), (92, "C1 c1 c1 r3"), (92, "r5 r6"), (None, "r7 c2"), (93, "one two same")]


@pytest.mark.parametrize("block, items_at_once", [(32_768, 2000), (60, 8)])
def test_search(spark, monkeypatch, block, items_at_once):
    docs, items = corpus()
    items += ODD_ITEMS
    make = lexical.build_index
    monkeypatch.setattr(lexical, "build_index", lambda d, w: make(d, w, block))
    monkeypatch.setattr(lexical, "ITEMS", items_at_once)
    out = lexical.search(frame(spark, docs), spark.createDataFrame(items, "item_id long, text string").withColumn("rank", F.lit("clash")))
    assert sorted(((r.item_id, r["rank"], r.doc_id, r.score) for r in out.collect()), key=str) == brute_search(docs, items)


def test_search_of_nothing(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    items = spark.createDataFrame([(1, "a")], "item_id long, text string")
    assert lexical.search(none, items).collect() == []
    assert lexical.search(frame(spark, documents()), items.limit(0)).collect() == []


def test_treaps_prune(spark):
    """Heap order over the doc_ids, and far fewer documents scored than hold a term."""
    docs, items = corpus()
    held = lexical._Block(None)
    for d, t in docs:
        held.add(d, (t or "").encode())
    row = held.row()
    row = {c: row.column(c)[0].values for c in ("doc_ids", "lengths", "terms", "holding", "places", "times")}
    row = {c: v.to_pylist() if c == "terms" else v.to_numpy(zero_copy_only=False) for c, v in row.items()}
    statistics = lexical.Statistics.__new__(lexical.Statistics)
    statistics.documents, statistics.terms, statistics.holding = held.documents, held.terms_in_all, dict(zip(row["terms"], row["holding"].tolist()))
    made = lexical.InvertedTreaps(row, statistics)
    for parent in range(len(made.places) - 1):
        for child, side in ((made.left[parent], -1), (made.right[parent], 1)):
            if child >= 0:
                assert made.impact[child] <= made.impact[parent] and (made.places[child] - made.places[parent]) * side > 0
    assert max(_depth(made, r) for r in made.root.tolist()) < 60
    visited = 0
    for _, text in items:
        terms = {w: statistics.weight(w) for w in set(lexical.terms_of(text))}
        visited += made.search(terms, 10, 0)[2]
    assert visited < 0.5 * len(made.doc_ids) * len(items)


def _depth(made, root):
    depth, level = 0, [root]
    while level:
        depth += 1
        level = [c for n in level for c in (made.left[n], made.right[n]) if c >= 0]
    return depth

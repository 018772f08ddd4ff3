"""Operator 11: byte-level BPE, encoding with character offsets and decoding.

A file of ranks (a token's bytes in base64, then its id) becomes a tokenizer of the tokenizers library: a token's
merge is the pair that the merges of lower rank leave of its bytes. The driver builds it once and sends it to the
tasks as a string, so only the driver reads the file. There are no special tokens; their strings are ordinary text.

* ``encode``: texts -> ids, and for each token the characters it touches (from, to). The library works on a
  byte alphabet of printable signs, so its tokens' lengths are bytes; a running count of the bytes that begin a
  character maps these to characters. A token may hold a part of a character: both tokens then name it.
* ``decode``: ids -> bytes by the reversed byte table, text, and the packed ids. Bytes that make no character
  become U+FFFD in the text, never in the bytes. ``pieces`` gives the text token by token and holds a split character back
  until its last byte has come.

Plan: no shuffle; a row is encoded and decoded in its own task. A single space between two signs that are no white space always starts
a match of the pattern, so texts are cut there; a worker keeps what it has met before in a bounded cache and
the library sees each other part once a batch. Rows leave a task ``ROWS`` at a time, or after ``CHARS`` characters.

Edge cases: null text is empty: no ids, no bytes; very long texts are encoded whole, in parts (a text without such a space is one part);
repeated rows each come back; an empty table gives an empty result; null doc_ids are kept. Other columns pass through, but for
those named as a result, which it replaces.
"""

from __future__ import annotations

import base64
import codecs
import json
import os
import re
from array import array
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

ROWS, CHARS = 500, 2 << 20
#: Entries of a worker's cache, the longest part that it keeps (it is emptied when full), and unknown parts encoded at a time.
CACHE, LONGEST, RUN = 300_000, 64, 500
#: Fixed value: the public byte-level BPE pattern.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""

ENCODED, SPANS = "ids array<int>", ", starts array<int>, ends array<int>"
DECODED = "decoded binary, decoded_text string, packed binary"

#: A space beside other white space, or at an end of the text.
_BLANKS = re.compile(r"\s | \s|^ | $").search
_CUTS = re.compile(r"(?<=\S) (?=\S)").split


def signs() -> list[str]:
    """The printable sign of each byte: itself, or the next from U+0100."""
    plain = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    rest = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(rest)) for b in range(256)]


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in f if line.strip())}


def merge_of(token: bytes, rank: int, ranks: dict[bytes, int]) -> tuple[bytes, bytes]:
    """The two parts that merges below ``rank`` make of a token, the least rank first, then the leftmost."""
    parts = [token[i : i + 1] for i in range(len(token))]
    while len(parts) > 2:
        best, at = min((ranks.get(parts[i] + parts[i + 1], rank), i) for i in range(len(parts) - 1))
        if best >= rank:
            raise ValueError(f"no merges lead to token {rank}")
        parts[at : at + 2] = [parts[at] + parts[at + 1]]
    return parts[0], parts[1]


def tokenizer_from_ranks(path: str, pattern: str = PATTERN) -> str:
    """The tokenizers library's form of a file of ranks, as its JSON string."""
    from tokenizers import Regex, Tokenizer, models, pre_tokenizers

    ranks, sign = read_ranks(path), signs()
    name = lambda token: "".join(map(sign.__getitem__, token))
    merges = [tuple(map(name, merge_of(t, r, ranks))) for t, r in sorted(ranks.items(), key=lambda x: x[1]) if len(t) > 1]
    made = Tokenizer(models.BPE(vocab={name(t): r for t, r in ranks.items()}, merges=merges, ignore_merges=True))
    made.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.Split(Regex(pattern), "isolated"), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
    return made.to_str()


class Encoder:
    """Texts -> little-endian 32-bit ids, as bytes."""

    def __init__(self, tokenizer: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        from tokenizers import Tokenizer

        self.library, self.lengths, self.known = Tokenizer.from_str(tokenizer), decoder(tokenizer).lengths, {}

    def __call__(self, texts: list[str]) -> list[bytes]:
        # parts after the first begin with the space that was cut away
        cuts = [_CUTS(t) if _BLANKS(t) else t.split(" ") for t in texts]
        # a last part that ends in white space would match on into the next one
        tails = [c.pop() if len(c) > 1 and c[-1][-1].isspace() else None for c in cuts]
        head, tail = self._alone({c[0] for c in cuts}, ""), self._alone({x for x in tails if x is not None}, " ") | {None: b""}
        parts = {p for c in cuts for p in c[1:]}
        fresh = list(parts.difference(self.known))
        known = self.known if len(self.known) + len(fresh) <= CACHE else {p: self.known[p] for p in parts if p in self.known}
        for at in range(0, len(fresh), RUN):
            known |= self._joined(fresh[at : at + RUN])
        out = [head[c[0]] + b"".join(map(known.__getitem__, c[1:])) + tail[x] for c, x in zip(cuts, tails)]
        for p in fresh:
            if len(p) > LONGEST:
                del known[p]
        self.known = known if len(known) <= CACHE else {}
        return out

    def _alone(self, parts: set[str], before: str) -> dict[str, bytes]:
        parts = list(parts)
        made = self.library.encode_batch_fast([before + p for p in parts], add_special_tokens=False)
        return {p: array("I", e.ids).tobytes() for p, e in zip(parts, made)}

    def _joined(self, parts: list[str]) -> dict[str, bytes]:
        """Ids of parts that follow a space, encoded as one text and told apart by their bytes."""
        text = " " + " ".join(parts)
        ids = np.array(self.library.encode_batch_fast([text], add_special_tokens=False)[0].ids, dtype="<u4")
        ends = np.cumsum([1 + len(p.encode()) for p in parts])
        at = [0, *(4 * (np.searchsorted(np.cumsum(self.lengths[ids]), ends) + 1)).tolist()]
        raw = ids.tobytes()
        return {p: raw[a:b] for p, a, b in zip(parts, at, at[1:])}


class Decoder:
    """Ids -> bytes and characters, by the reversed byte table."""

    def __init__(self, tokenizer: str):
        byte = {c: b for b, c in enumerate(signs())}
        vocab = json.loads(tokenizer)["model"]["vocab"]
        self.tokens = [b""] * (1 + max(vocab.values(), default=-1))
        for token, i in vocab.items():
            self.tokens[i] = bytes(map(byte.__getitem__, token))
        self.lengths = np.array(list(map(len, self.tokens)), dtype=np.int64)

    def bytes_of(self, ids: list[int]) -> bytes:
        return b"".join(map(self.tokens.__getitem__, ids))

    def pieces(self, ids: list[int]) -> list[str]:
        """The text that each token completes; a character split over tokens comes with the last of them, an unfinished one at the end as U+FFFD."""
        feed = codecs.getincrementaldecoder("utf-8")("replace").decode
        return [feed(self.tokens[i], k == len(ids) - 1) for k, i in enumerate(ids)]

    def offsets(self, ids: np.ndarray, text: bytes) -> tuple[np.ndarray, np.ndarray]:
        """The first character of each token, and the one after its last."""
        ends = np.cumsum(self.lengths[ids])
        character = np.cumsum((np.frombuffer(text, np.uint8) & 0xC0) != 0x80)
        return (character[ends - self.lengths[ids]] - 1).astype(np.int32), character[ends - 1].astype(np.int32)


@lru_cache(maxsize=4)
def encoder(tokenizer: str) -> Encoder:
    return Encoder(tokenizer)


@lru_cache(maxsize=4)
def decoder(tokenizer: str) -> Decoder:
    return Decoder(tokenizer)


def _lists(arrays: list[np.ndarray]) -> pa.Array:
    ends = np.cumsum([0, *map(len, arrays)], dtype=np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(arrays).astype(np.int32) if arrays else np.zeros(0, np.int32)))


def _portions(texts: list[str]):
    """(from, to) of at most ``ROWS`` rows and about ``CHARS`` characters."""
    at = size = 0
    for i, t in enumerate(texts):
        if i > at and (i - at == ROWS or size + len(t) > CHARS):
            yield at, i
            at, size = i, 0
        size += len(t)
    if at < len(texts):
        yield at, len(texts)


def _add(batch: pa.RecordBatch, added: dict[str, pa.Array]) -> pa.RecordBatch:
    kept = [c for c in batch.schema.names if c not in added]
    return pa.RecordBatch.from_arrays([*[batch.column(c) for c in kept], *added.values()], names=[*kept, *added])


def _schema(df: DataFrame, added: str) -> str:
    names = {x.split()[0] for x in added.split(", ")}
    return ", ".join([*[f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema if f.name not in names], added])


def _encoded(batches, tokenizer: str, offsets: bool, text: str):
    encode_all, of = encoder(tokenizer), decoder(tokenizer)
    for batch in batches:
        texts = [t or "" for t in batch.column(text).to_pylist()]
        for a, b in _portions(texts):
            ids = [np.frombuffer(x, "<i4") for x in encode_all(texts[a:b])]
            out = {"ids": _lists(ids)}
            if offsets:
                spans = [of.offsets(x, t.encode()) if len(x) else (x, x) for x, t in zip(ids, texts[a:b])]
                out |= {"starts": _lists([s for s, _ in spans]), "ends": _lists([e for _, e in spans])}
            yield _add(batch.slice(a, b - a), out)


def _decoded(batches, tokenizer: str):
    of = decoder(tokenizer)
    for batch in batches:
        for a in range(0, batch.num_rows, ROWS):
            part = batch.slice(a, ROWS)
            ids = [[] if x is None else x for x in part.column("ids").to_numpy(zero_copy_only=False)]
            raw = [of.bytes_of(x.tolist() if len(x) else x) for x in ids]
            out = {
                "decoded": pa.array(raw, pa.binary()),
                "decoded_text": pa.array([x.decode("utf-8", "replace") for x in raw], pa.string()),
                "packed": pa.array([np.array(x, dtype="<u4").tobytes() for x in ids], pa.binary()),
            }
            yield _add(part, out)


def encode(docs: DataFrame, tokenizer: str, offsets: bool = True, text: str = "text") -> DataFrame:
    """docs with ids and, with ``offsets``, starts and ends (characters of each token)."""
    return docs.mapInArrow(lambda batches: _encoded(batches, tokenizer, offsets, text), _schema(docs, ENCODED + SPANS * offsets))


def decode(tokens: DataFrame, tokenizer: str) -> DataFrame:
    """tokens (ids, ...) with decoded (bytes), decoded_text, and packed (ids as little-endian 32-bit numbers). Null ids are none."""
    return tokens.mapInArrow(lambda batches: _decoded(batches, tokenizer), _schema(tokens, DECODED))


def round_trip(docs: DataFrame, tokenizer: str, text: str = "text") -> DataFrame:
    """``decode`` of ``encode`` in one Python worker, without ``text``."""
    kept = docs.drop(text)

    def run(batches):
        for batch in _decoded(_encoded(batches, tokenizer, True, text), tokenizer):
            yield batch.select([c for c in batch.schema.names if c != text])

    return docs.mapInArrow(run, _schema(kept, f"{ENCODED}{SPANS}, {DECODED}"))


def digests(tokens: DataFrame) -> DataFrame:
    """decoded tokens with n_tokens, n_split (tokens that begin inside a character), ids_sha256 and decoded_sha256."""
    shared = F.size(F.filter(F.transform("starts", lambda s, i: (i > 0) & (F.get("ends", i - 1) > s)), lambda x: x))
    return tokens.withColumns(
        {"n_tokens": F.size("ids").cast("long"), "n_split": shared.cast("long"), "ids_sha256": F.sha2("packed", 256), "decoded_sha256": F.sha2("decoded", 256)}
    )

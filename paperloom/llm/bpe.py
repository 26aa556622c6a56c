"""BPE encoding by backtracking, and decoding by an offset table.

A byte-level BPE vocabulary whose ids follow the merge order defines, for any two neighbouring
tokens, whether the merges would leave them as they are (the pair is compatible). The encoding of a
piece is the only sequence of tokens in which all neighbours are compatible. The encoder takes the
longest token at its place (found for all places in one Aho-Corasick pass), checks it against its
left neighbour, falls back to the next shorter token that is its prefix, and steps back one token
when none is left. A bit for each place notes that nothing fits from there, so each place is left
at most once and the work is linear in the piece's length.

Pieces are what the pre-tokeniser's pattern cuts; a worker keeps those it has met lately.
Decoding lays all tokens' bytes in one array with their offsets and gathers by index.
"""

from __future__ import annotations

import json
from array import array

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import over_texts, slices, table

TOKENIZER = "byte_bpe_50k.json"
#: Fixed value: the pre-tokeniser's pattern, with white space as Unicode defines it.
PIECES = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\p{White_Space}\p{L}\p{N}]+|\p{White_Space}+(?!\P{White_Space})|\p{White_Space}+"
#: Pieces of each of two generations and pairs that a worker keeps, some 140 MB; ids decoded at a time.
KEEP, KEEP_PAIRS = 100_000, 150_000
ROWS, IDS = 1_000, 1 << 18


def byte_of_char() -> dict[str, int]:
    """Byte-level vocabularies write printable Latin-1 bytes as they are, others from U+0100 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class Decoder:
    """Tokens' bytes end to end, with offsets; built once in each Python worker that decodes."""

    def __init__(self, spec: str):
        self.spec = json.loads(spec)
        chars, vocab = byte_of_char(), self.spec["model"]["vocab"]
        self.special = {a["content"]: a["id"] for a in self.spec["added_tokens"]}
        self.tokens = [b""] * (max([*vocab.values(), *self.special.values()]) + 1)
        for s, i in vocab.items():
            self.tokens[i] = bytes(chars[c] for c in s)
        self.ids = {b: i for i, b in enumerate(self.tokens) if b}
        for s, i in self.special.items():
            self.tokens[i] = s.encode()
        self.sizes = np.array([len(b) for b in self.tokens], dtype=np.int64)
        self.starts = np.cumsum(self.sizes) - self.sizes
        self.bytes = np.frombuffer(b"".join(self.tokens), dtype=np.uint8)
        self.prepare()
        del self.spec

    def prepare(self) -> None:
        """What a decoder does without."""

    def decode(self, ids: np.ndarray, ends: np.ndarray) -> list[str]:
        """Texts of many documents: ids end to end, and where each document's ids end."""
        upto, parts = np.concatenate([[0], np.cumsum(self.sizes[ids])]), []
        for k in range(0, len(ids), IDS):
            some = ids[k : k + IDS]
            sizes = self.sizes[some]
            before = np.cumsum(sizes) - sizes
            parts.append(self.bytes[np.arange(sizes.sum()) + np.repeat(self.starts[some] - before, sizes)].tobytes())
        data, marks = b"".join(parts), upto[np.concatenate([[0], ends])]
        return [data[a:b].decode("utf-8", "replace") for a, b in zip(marks, marks[1:])]


class Codec(Decoder):
    """Encoder of one vocabulary."""

    def prepare(self) -> None:
        vocab = self.spec["model"]["vocab"]
        self.merged: dict[tuple[int, int], int] = {}
        self.parts: dict[int, tuple[int, int]] = {}
        for m in self.spec["model"]["merges"]:
            a, b = m.split(" ") if isinstance(m, str) else m
            pair, to = (vocab[a], vocab[b]), vocab[a + b]
            self.merged[pair] = to
            self.parts[to] = pair
        if any(max(p) >= to for to, p in self.parts.items()):
            raise ValueError("the vocabulary's ids do not follow its merges")
        self.shorter = {i: next((self.ids[b[:k]] for k in range(len(b) - 1, 0, -1) if b[:k] in self.ids), None) for b, i in self.ids.items()}
        self.found = ahocorasick.Automaton()
        for b, i in self.ids.items():
            self.found.add_word(b.decode("latin-1"), (i, len(b) - 1))
        self.found.make_automaton()
        self.pieces = regex.compile(PIECES)
        self.cut = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        self.seen: dict[str, bytes] = {}
        self.before: dict[str, bytes] = {}  # the generation before `seen`; what is met again moves on
        self.pairs: dict[int, bool] = {}
        self.lengths = [len(b) for b in self.tokens]

    def compatible(self, left: int, right: int) -> bool:
        """The entry of the pair-compatibility table, filled as pairs come up: whether no merge across the border comes before the merges that made the two tokens.

        The newest merge on either side is undone, step by step down to bytes; a pair at the border
        that merges earlier than what was undone last shows that the tokens would not have formed.
        """
        newest = len(self.tokens)
        while True:
            if self.merged.get((left, right), newest) < newest:
                return False
            undo_left = left > right
            newest = left if undo_left else right + 1
            for _ in range(2):
                if undo_left and left in self.parts:
                    left = self.parts[left][1]
                    break
                if not undo_left and right in self.parts:
                    right = self.parts[right][0]
                    break
                undo_left = not undo_left
                newest = left if undo_left else right + 1
            else:
                return True

    def piece(self, data: bytes) -> list[int]:
        """Token ids of one piece."""
        if (whole := self.ids.get(data)) is not None:
            return [whole]
        size = len(data)
        longest: list[int | None] = [None] * size
        for end, (token, n) in self.found.iter(data.decode("latin-1")):
            longest[end - n] = token  # ends ascend, so the longest comes last
        lengths, shorter, pairs = self.lengths, self.shorter, self.pairs
        open_at, out, at, left, token = bytearray(b"\1") * (size + 1), [], 0, -1, longest[0]
        while True:
            while token is not None:
                end = at + lengths[token]
                if open_at[end]:
                    if left < 0:
                        break
                    pair = left << 20 | token
                    fits = pairs.get(pair)
                    if fits is None:
                        fits = pairs[pair] = self.compatible(left, token)
                    if fits:
                        break
                token = shorter[token]
            if token is None:
                open_at[at] = 0
                if left < 0:
                    raise ValueError("the vocabulary lacks a byte")
                token = shorter[out.pop()]
                at -= lengths[left]
                left = out[-1] if out else -1
            else:
                out.append(token)
                if end == size:
                    return out
                at, left, token = end, token, longest[end]

    def forget(self) -> None:
        """Empty the caches, so that an idle worker holds the vocabulary alone."""
        self.seen.clear()
        self.before.clear()
        self.pairs.clear()

    def encode(self, text: str) -> bytes:
        """The ids as little-endian 32-bit numbers."""
        seen, before, out = self.seen, self.before, []
        for i, part in enumerate(self.cut.split(text) if self.cut else [text]):
            if i % 2:
                out.append(np.int32(self.special[part]).tobytes())
                continue
            for p in self.pieces.findall(part):
                got = seen.get(p)
                if got is None:
                    got = before.get(p)
                    if got is None:
                        if len(self.pairs) >= KEEP_PAIRS:
                            self.pairs.clear()
                        got = array("i", self.piece(p.encode())).tobytes()
                    if len(p) < 64:
                        if len(seen) >= KEEP:
                            self.before, self.seen = before, seen = seen, {}
                        seen[p] = got
                out.append(got)
        return b"".join(out)


_built: dict[type, tuple[int, Decoder]] = {}


def _codec(spec, kind: type):
    """This worker's codec of that vocabulary."""
    if kind not in _built or _built[kind][0] != spec.id:
        _built[kind] = spec.id, kind(spec.value)
    return _built[kind][1]


def tokenizer_path(path: str | None = None) -> str:
    """The vocabulary file: `path`, or the public tokenizers' TOKENIZER."""
    if path:
        return path
    import public_tokenizers

    return str(public_tokenizers.path(TOKENIZER))


def _spec(spark, path: str | None):
    """The vocabulary file, read once on the driver: its size is fixed, 2 MB."""
    with open(tokenizer_path(path), encoding="utf-8") as f:
        return _Spec(spark.sparkContext.broadcast(f.read()))


class _Spec:
    def __init__(self, sent):
        self.sent, self.id = sent, sent._jbroadcast.id()

    def __getstate__(self):
        return {"sent": self.sent, "id": self.id}

    @property
    def value(self):
        return self.sent.value


def encode(df: DataFrame, text_col: str = "text", path: str | None = None, decoded: str | None = None) -> DataFrame:
    """Add ids array<int>. A null text counts as empty and has no ids; a column `ids` is replaced.

    `decoded` names a column for the text of those ids, as `decode` gives it: the worker that encoded decodes
    them too, so that a task needs one worker with one vocabulary and not two.
    """
    df, spec = df.drop("ids", *([decoded] if decoded else [])), _spec(df.sparkSession, path)
    more = [T.StructField(decoded, T.StringType(), False)] if decoded else []
    schema = T.StructType([*df.schema.fields, T.StructField("ids", T.ArrayType(T.IntegerType(), False), False), *more])
    column = df.columns.index(text_col)

    def run(batches):
        codec = _codec(spec, Codec)
        for big in batches:
            for b in slices(big, column, ROWS):
                coded = [codec.encode(t or "") for t in b.column(column).to_pylist()]
                ends, flat = np.cumsum([0, *(len(c) // 4 for c in coded)], dtype=np.int32), np.frombuffer(b"".join(coded), dtype="<i4")
                ids = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat, pa.int32()))
                texts = [pa.array(codec.decode(flat, ends[1:]), pa.string())] if decoded else []
                yield pa.RecordBatch.from_arrays([*b.columns, ids, *texts], names=schema.names)
        codec.forget()

    return over_texts(df, run, schema)


def decode(df: DataFrame, ids_col: str = "ids", out: str = "decoded", path: str | None = None) -> DataFrame:
    """Add the text of an ids column; a null list gives the empty text."""
    df, spec = df.drop(out), _spec(df.sparkSession, path)
    schema = T.StructType([*df.schema.fields, T.StructField(out, T.StringType(), False)])
    column = df.columns.index(ids_col)

    def run(batches):
        codec = _codec(spec, Decoder)
        for big in batches:
            for b in slices(big, column, ROWS, 4 * IDS):
                lists = b.column(column)
                sizes = lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
                texts = codec.decode(lists.flatten().to_numpy(zero_copy_only=False), np.cumsum(sizes, dtype=np.int64))
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array(texts, pa.string())], names=[*b.schema.names, out])

    return over_texts(df, run, schema)


def op9_bpe(spark, sf_dir):
    both = encode(table(spark, sf_dir, "documents").select("doc_id", "text"), decoded="decoded")
    return both.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


QUERIES = {"op9_bpe": op9_bpe}
ORACLES: dict[str, str] = {}

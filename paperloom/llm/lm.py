"""Language-model scoring by Katz backoff over word bigrams.

Tokens are words, A-Z lowered, then one end. P(w | v) = d(c) * c(v, w) / den(v) where (v, w) was seen in
training, else alpha(v) * P(w), and P(w) where v was never seen; P(w) = (c(w) + 1) / (N + V + 1) ends the
recursion. The first token's context is a mark. d(c) is the Good-Turing discount for counts up to K, from
counts of counts of the whole training part; den(v) is c(v), and one more where v has no discounted count or
`many` tokens, so something is left for what was not seen. alpha(v) makes the probabilities after v sum to one:
its sums are over whole numbers.

How it runs. Texts are read block by block and never move.

* Word counts are one aggregate. The most frequent words (sizes.common of them, 16 bytes each: 4 MB) get codes,
  which are sent to executors with their counts; other words stand for themselves as 62-bit hashes, and their counts
  are joined to where they are needed.
* Each block sends its pairs with their training counts and the documents they are in to the bucket of their
  context, packed. Contexts with more tokens than a bucket should hold are spread over buckets by their second
  word. The most frequent pairs, sizes.heavy at most, are scored in the block itself, so no
  pair's documents pile up in one bucket: only their counts are sent.
* A bucket merges its pairs into rows of the gram table (context, word, counts, documents), which is stored. A
  pass over it adds up log probabilities for each document.

Two words with the same hash count as one. Null and empty texts hold one token, the end. Rows may repeat, and
ids too; an id is never a key. An empty table gives no rows. Texts may be of any length: one is a block.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import over_texts, scratch, slices, table, written

K = 5
END, BOS = (xxhash.xxh3_64_intdigest(b" " * n) >> 2 for n in (1, 2))  # no word holds a blank


@dataclass(frozen=True)
class Sizes:
    """many is part of the model; the others set how work is cut up, and change no result."""

    many: int = 4096
    common: int = 1 << 18
    heavy: int = 1 << 16
    least_local: int = 8
    block: int = 3 << 20
    bucket: int = 1 << 19
    chunk: int = 256
    docs: int = 200_000


def hashes(words: list[bytes]) -> np.ndarray:
    return np.array([xxhash.xxh3_64_intdigest(w) >> 2 for w in words], dtype=np.int64)


@dataclass
class Block:
    """Some documents' tokens: word[cur[i]] is token i's word, prev[i] its context's place in word, doc[i] its document."""

    ids: pa.Array
    train: np.ndarray
    word: np.ndarray
    cur: np.ndarray
    prev: np.ndarray
    doc: np.ndarray

    def pairs(self):
        """Distinct pairs as places in word, and each token's pair."""
        n = len(self.word)
        key, of = np.unique(self.prev * n + self.cur, return_inverse=True)
        return key // n, key % n, of


def blocks(batches, size: int):
    """Blocks of up to `size` bytes of text, or one text, from batches of (id, train, text)."""
    for big in batches:
        for b in slices(big, 2, big.num_rows, size):
            words = pc.ascii_split_whitespace(pc.ascii_lower(pc.fill_null(b.column(2), "")))
            doc, words = pc.list_parent_indices(words), words.flatten()
            whole = pc.not_equal(pc.binary_length(words), 0)  # what is before a leading blank is empty
            doc, coded = doc.filter(whole).to_numpy(), words.filter(whole).dictionary_encode()
            known = hashes(coded.dictionary.cast(pa.binary()).to_pylist())
            n, m = len(known), b.num_rows
            ends = np.cumsum(np.bincount(doc, minlength=m) + 1) - 1
            cur = np.full(len(doc) + m, n)  # an end after each document
            cur[np.delete(np.arange(len(cur)), ends)] = coded.indices.to_numpy()
            prev = np.append(n + 1, cur[:-1])
            prev[ends[:-1] + 1] = n + 1
            yield Block(b.column(0), pc.fill_null(b.column(1), False).to_numpy(zero_copy_only=False), np.append(known, [END, BOS]), cur, prev, np.repeat(np.arange(m), np.diff(ends, prepend=-1)))


def packed(a: np.ndarray) -> bytes:
    """Whole numbers as eight planes of bytes: what is small or sorted compresses well."""
    return np.ascontiguousarray(np.asarray(a, dtype="<i8").view(np.uint8).reshape(-1, 8).T).tobytes()


def unpacked(b: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(b, dtype=np.uint8).reshape(8, -1).T).view("<i8").ravel()


def joined(column) -> tuple[np.ndarray, np.ndarray]:
    """The numbers of several packed values, and which value each is of."""
    parts = [unpacked(b) for b in column.to_pylist()]
    return np.concatenate([*parts, np.zeros(0, np.int64)]), np.repeat(np.arange(len(parts)), [len(p) for p in parts])


def mixed(a: np.ndarray) -> np.ndarray:
    x = a.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    return (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9) >> np.uint64(16)


def places(of: np.ndarray, among: np.ndarray) -> np.ndarray:
    """Place of each value in a sorted array, or -1."""
    if not len(among):
        return np.full(len(of), -1)
    at = np.minimum(np.searchsorted(among, of), len(among) - 1)
    return np.where(among[at] == of, at, -1)


@dataclass
class Words:
    """Common words, the context mark among them: sorted hashes, each one's code, and counts by code. N, V, buckets.

    A code is a rank by frequency, so those met most are small; a rare word's is its hash, moved beyond them.
    """

    hashes: np.ndarray
    codes: np.ndarray
    counts: np.ndarray
    n: int
    v: int
    docs: int
    buckets: int
    heavy: np.ndarray  # sorted code * len(hashes) + code
    heavy_counts: np.ndarray
    sizes: Sizes

    @property
    def total(self) -> int:
        return self.n + self.v + 1

    def coded(self, word: np.ndarray) -> np.ndarray:
        at = places(word, self.hashes)
        return np.where(at >= 0, self.codes[at], word + len(self.hashes))

    def count(self, code: np.ndarray) -> np.ndarray:
        """Training count of common codes; -1 for rare words."""
        return np.where(code < len(self.hashes), self.counts[np.minimum(code, len(self.hashes) - 1)], -1)

    def hot(self, code: np.ndarray) -> np.ndarray:
        return self.count(code) > self.sizes.bucket // 4

    def bucket(self, v: np.ndarray, w: np.ndarray) -> np.ndarray:
        shares = np.where(self.hot(v), 1 + self.count(v) * 4 // self.sizes.bucket, 1).astype(np.uint64)
        return ((mixed(v) + mixed(w) % shares) % np.uint64(self.buckets)).astype(np.int64)


def word_counts(docs: DataFrame, sizes: Sizes) -> DataFrame:
    """(a, b, c): training counts of words a, with b null, and of pairs as far as a block holds sizes.least_local of them."""

    def run(batches):
        for x in blocks(batches, sizes.block):
            use = x.train[x.doc]
            count = np.bincount(x.cur[use], minlength=len(x.word))
            count[-1] = x.train.sum()
            v, w, of = x.pairs()
            both = np.bincount(of[use], minlength=len(v))
            many, some = both >= sizes.least_local, count > 0
            b = pa.concat_arrays([pa.nulls(int(some.sum()), pa.int64()), pa.array(x.word[w[many]])])
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([x.word[some], x.word[v[many]]])), b, pa.array(np.concatenate([count[some], both[many]]))], names=["a", "b", "c"])

    return over_texts(docs, run, "a long, b long, c long").groupBy("a", "b").agg(F.sum("c").alias("c"))


def fit_words(counted: DataFrame, sizes: Sizes) -> Words:
    """Codes of the commonest words, and candidates for heavy pairs, without their exact counts."""
    words = counted.filter("b is null")
    mark = F.col("a") == BOS
    whole = words.agg(F.sum(F.when(~mark, F.col("c"))).alias("n"), F.count_if(~mark).alias("v"), F.sum(F.when(mark, F.col("c"))).alias("docs")).first()
    partitions = int(counted.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    n, v, n_docs = (int(whole[c] or 0) for c in ("n", "v", "docs"))
    top = words.filter(~mark).orderBy(F.desc("c"), "a").limit(sizes.common).toArrow()
    known, counts = (np.append(top[c].to_numpy(), x).astype(np.int64) for c, x in (("a", BOS), ("c", n_docs)))
    order = np.argsort(known)
    model = Words(known[order], order, counts, n, v, n_docs, max(partitions, -(-n * 7 // 6 // sizes.bucket)), np.zeros(0, np.int64), np.zeros(0, np.int64), sizes)
    pairs = counted.filter("b is not null").orderBy(F.desc("c"), "a", "b").limit(sizes.heavy).toArrow()
    a, b = (model.coded(pairs[c].to_numpy()) for c in ("a", "b"))
    keep = (b < len(model.hashes)) & (model.count(a) >= sizes.many)
    model.heavy = np.sort(a[keep] * len(model.hashes) + b[keep])
    return model


def requests(docs: DataFrame, model: Words) -> DataFrame:
    """(bucket, word, c): the rare words that each bucket's pairs end with, bucket -1 - k with c: training count of heavy pair k."""
    sizes = model.sizes

    def run(batches):
        for x in blocks(batches, sizes.block):
            v, w, of = x.pairs()
            code = model.coded(x.word)
            rare = code[w] >= len(model.hashes)
            bucket, word = model.bucket(code[v[rare]], code[w[rare]]), x.word[w[rare]]
            order = np.lexsort([word, bucket])
            bucket, word = bucket[order], word[order]
            new = np.append(True, (np.diff(bucket) != 0) | (np.diff(word) != 0))[: len(word)]
            heavy = places(np.where(rare, -1, code[v] * len(model.hashes) + code[w]), model.heavy)
            count = np.bincount(of[x.train[x.doc]], minlength=len(v))
            own = heavy >= 0
            columns = np.concatenate([bucket[new], -1 - heavy[own]]), np.concatenate([word[new], 0 * heavy[own]]), np.concatenate([0 * word[new], count[own]])
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=["bucket", "word", "c"])

    return over_texts(docs, run, "bucket long, word long, c long").groupBy("bucket", "word").agg(F.sum("c").alias("c"))


#: A document's number: its task, block in the task (together: its block), and place in the block.
DOC_BITS = 24
PACK = "bucket long, v binary, w binary, c binary, posts binary, docs binary, ids array<{id}>, held array<boolean>, sums binary"
NAMES = ["bucket", "v", "w", "c", "posts", "docs", "ids", "held", "sums"]


def packs(docs: DataFrame, model: Words, id_kind: str) -> DataFrame:
    """A row for each block and bucket, and one for the block itself (its bucket is -1 - block) with what is scored at home."""
    sizes = model.sizes
    logs = np.log10(model.heavy_counts / (model.counts[model.heavy // len(model.hashes)] + 1.0))

    def run(batches):
        task = TaskContext.get().partitionId() << 16 + DOC_BITS
        for number, x in enumerate(blocks(batches, sizes.block)):
            v, w, of = x.pairs()
            code, block = model.coded(x.word), task + (number << DOC_BITS)
            count = np.bincount(of[x.train[x.doc]], minlength=len(v))
            cw = model.count(code)
            key = np.where((code[v] < len(model.hashes)) & (code[w] < len(model.hashes)), code[v] * len(model.hashes) + code[w], -1)
            heavy = places(key, model.heavy)
            own, m = heavy[of] >= 0, len(x.ids)
            score = np.bincount(x.doc[own], weights=logs[heavy[of[own]]], minlength=m)
            here = cw[x.cur] >= 0
            base = np.bincount(x.doc[here], weights=np.log10(cw[x.cur[here]] + 1.0), minlength=m)
            tokens, known = np.bincount(x.doc, minlength=m), np.bincount(x.doc[here], minlength=m)
            kind = pa.list_(x.ids.type)
            rows = [[-1 - block, None, None, None, None, None, x.ids.to_pylist(), (~x.train).tolist(), np.stack([score, base, tokens, known]).astype(float).tobytes()]]
            # pairs in order of bucket, context and word; their documents in the same order
            bucket = model.bucket(code[v], code[w])
            order = np.lexsort([code[w], code[v], bucket])
            rank = np.empty(len(v), np.int64)
            rank[order] = np.arange(len(v))
            away = np.flatnonzero(~own)
            away = away[np.argsort(rank[of[away]], kind="stable")]
            posts = np.bincount(rank[of[away]], minlength=len(v))
            begin = np.concatenate([[0], np.cumsum(posts)])
            need = (posts > 0) | (count[order] > 0)
            cut = np.flatnonzero(np.diff(bucket[order], prepend=-1, append=-1))
            for a, b in zip(cut[:-1], cut[1:]):
                o = order[a:b][need[a:b]]
                if len(o):
                    rows.append([int(bucket[order[a]]), packed(code[v[o]]), packed(code[w[o]]), packed(count[o]), packed(posts[a:b][need[a:b]]), packed(block + x.doc[away[begin[a] : begin[b]]]), None, None, None])
            kinds = [pa.int64(), *[pa.binary()] * 5, kind, pa.list_(pa.bool_()), pa.binary()]
            for k in range(0, len(rows), 256):
                part = list(zip(*rows[k : k + 256]))
                yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(part, kinds)], names=NAMES)

    return over_texts(docs, run, PACK.format(id=id_kind))


GRAM = "kind int, v binary, w binary, c binary, cw binary, posts binary, docs binary, stats binary, ids array<{id}>, held array<boolean>, sums binary"
HOME, PAIRS, COUNTS, HOT = 0, 1, 2, 3


def grams(rows: DataFrame, rare: DataFrame, model: Words, id_kind: str) -> DataFrame:
    """The gram table: of kind PAIRS rows of up to sizes.chunk merged pairs with their contexts' sums; of kind COUNTS how
    many pairs have each count up to K + 1; of kind HOT a bucket's part of a hot context's sums; of kind HOME what blocks scored."""

    chunk = model.sizes.chunk

    def merge(left: pa.Table, right: pa.Table) -> pa.Table:
        empty, schema = [None] * 11, _arrow(left.schema.field("ids").type)
        out = []
        if not left.num_rows:
            return pa.table([pa.array([], f.type) for f in schema], schema=schema)
        if left["bucket"][0].as_py() < 0:
            for k in range(left.num_rows):
                out.append([HOME, *empty[:5], packed(np.array([-1 - left["bucket"][0].as_py()])), None, left["ids"][k].as_py(), left["held"][k].as_py(), left["sums"][k].as_py()])
            return _table(out, schema)
        (v, _), (w, _), (c, _), (posts, _), (docs, _) = (joined(left[n]) for n in ("v", "w", "c", "posts", "docs"))
        order = np.lexsort([w, v])
        new = np.append(True, (np.diff(v[order]) != 0) | (np.diff(w[order]) != 0))
        pair = np.empty(len(v), np.int64)
        pair[order] = np.cumsum(new) - 1
        first = order[new]
        v, w, count = v[first], w[first], np.bincount(pair, weights=c).astype(np.int64)
        owner = np.repeat(pair, posts)
        docs = docs[np.argsort(owner, kind="stable")]
        posts = np.bincount(owner, minlength=len(v))
        cw = model.count(w)
        asked = np.sort(right["word"].to_numpy())
        found = places(w[cw < 0] - len(model.hashes), asked)
        of = right["c"].to_numpy()[np.argsort(right["word"].to_numpy(), kind="stable")]
        cw[cw < 0] = np.where(found >= 0, of[found] if len(of) else 0, 0)
        # sums of each context: c(v), how many of its pairs have count 1 to K, sum of c(w) + 1 over pairs seen
        start = np.flatnonzero(np.diff(v, prepend=-1))
        seen = count > 0
        sums = [np.add.reduceat(count, start), *(np.add.reduceat((count == r).astype(np.int64), start) for r in range(1, K + 1)), np.add.reduceat(np.where(seen, cw + 1, 0), start)]
        stats, context = np.stack(sums, axis=1), np.cumsum(np.diff(v, prepend=-1) != 0) - 1
        out.append([COUNTS, *empty[:6], packed(np.bincount(count[seen & (count <= K + 1)], minlength=K + 2)[1:]), *empty[:3]])
        hot = np.flatnonzero(model.hot(v[start]))
        if len(hot):
            out.append([HOT, packed(v[start][hot]), *empty[:5], packed(stats[hot].ravel()), *empty[:3]])
        begin = np.concatenate([[0], np.cumsum(posts)])
        for k in range(0, len(v), chunk):
            s = slice(k, k + chunk)
            mine = np.unique(context[s])
            out.append([PAIRS, packed(v[s]), packed(w[s]), packed(count[s]), packed(cw[s]), packed(posts[s]), packed(docs[begin[k] : begin[min(len(v), k + chunk)]]), packed(stats[mine].ravel()), *empty[:3]])
        return _table(out, schema)

    return rows.groupBy("bucket").cogroup(rare.groupBy("bucket")).applyInArrow(merge, GRAM.format(id=id_kind))


def _arrow(ids: pa.DataType) -> pa.Schema:
    return pa.schema([("kind", pa.int32()), *((n, pa.binary()) for n in ("v", "w", "c", "cw", "posts", "docs", "stats")), ("ids", ids), ("held", pa.list_(pa.bool_())), ("sums", pa.binary())])


def _table(rows: list, schema: pa.Schema) -> pa.Table:
    return pa.table([pa.array(list(c), f.type) for c, f in zip(zip(*rows), schema)], schema=schema)


def discounts(n: list[int]) -> np.ndarray:
    """d(r) for r = 0 .. K + 1 by Good-Turing and Katz from n[r - 1], the number of pairs of count r; 1 beyond.

    The largest k up to K with all of d(1) .. d(k) between 0 and 1 is taken; if there is none, half a count goes.
    """
    for k in range(K, 0, -1):
        if all(n[: k + 1]):
            out, last = np.ones(K + 2), (k + 1) * n[k] / n[0]
            out[1 : k + 1] = [((r + 1) * n[r] / n[r - 1] / r - last) / (1 - last) if last != 1 else 0 for r in range(1, k + 1)]
            if (out[1 : k + 1] > 0).all() and (out[1 : k + 1] < 1).all():
                return out
    return np.append(np.append(1, (np.arange(1, K + 1) - 0.5) / np.arange(1, K + 1)), 1)


def probabilities(count, cw, stats, context, d: np.ndarray, total: int, many: int) -> np.ndarray:
    """log10 P(w | v) of pairs; stats by context: c(v), its pairs by count, sum of c(w) + 1 over pairs seen."""
    cv, by, seen = stats[:, 0], stats[:, 1 : K + 1], stats[:, K + 1]
    freed = by @ ((1 - d[1 : K + 1]) * np.arange(1, K + 1))
    more = (cv > 0) & ((cv >= many) | (freed == 0))
    den = np.maximum(cv + more, 1)
    left = np.where(cv > 0, np.log10(np.maximum((freed + more) / den, 1e-300)) - np.log10((total - seen) / total), 0)
    own = d[np.minimum(count, K + 1)] * count / den[context]
    lower = left[context] + np.log10((cw + 1) / total)
    return np.where(count > 0, np.log10(np.where(count > 0, own, 1)), lower)


@dataclass
class Katz:
    """words and the stored gram table; d: discounts; hot: sums of the contexts that are spread over buckets."""

    words: Words
    grams: DataFrame
    d: np.ndarray
    hot: dict[int, np.ndarray]


def fit(df: DataFrame, train, text_col: str = "text", id_col: str = "doc_id", sizes: Sizes = Sizes()) -> Katz:
    """Count a table; `train`, a condition, picks the documents to learn from, a null counts as no.

    df should be stored: its rows are read three times. The driver gets the common words, heavy pairs, counts
    of counts and sums of hot contexts, of which there are 4 * N / sizes.bucket at most.
    """
    docs = df.select(F.col(id_col).alias("id"), F.coalesce(train, F.lit(False)).alias("train"), F.col(text_col).alias("text"))
    kind = docs.schema["id"].dataType.simpleString()
    counted = written(word_counts(docs, sizes), "words")
    model = fit_words(counted, sizes)
    asked = written(requests(docs, model), "requests")
    exact = {-1 - r["bucket"]: r["c"] for r in asked.filter("bucket < 0").collect()}  # at most sizes.heavy
    count = np.array([exact.get(k, 0) for k in range(len(model.heavy))], dtype=np.int64)
    model.heavy, model.heavy_counts = model.heavy[count > K], count[count > K]
    words = counted.filter("b is null").select(F.col("a").alias("word"), F.col("c").alias("known"))
    rare = asked.filter("bucket >= 0").drop("c").join(words.hint("merge"), "word").select("bucket", "word", F.col("known").alias("c"))
    stored = written(grams(packs(docs, model, kind), rare, model, kind), "grams", keep=True, codec="zstd")
    small = stored.filter(F.col("kind").isin(COUNTS, HOT)).select("kind", "v", "stats")

    def added(batches):
        total, hot = np.zeros(K + 1, np.int64), {}
        for b in batches:
            for k, v, s in zip(*(b.column(i).to_pylist() for i in range(3))):
                if k == COUNTS:
                    total += unpacked(s)
                else:
                    for a, row in zip(unpacked(v).tolist(), unpacked(s).reshape(-1, K + 2)):
                        hot[a] = hot.get(a, 0) + row
        items = [(-1 - r, 0, int(x)) for r, x in enumerate(total)] + [(a, i, int(x)) for a, row in hot.items() for i, x in enumerate(row)]
        yield pa.RecordBatch.from_arrays([pa.array(list(c), pa.int64()) for c in zip(*items)], names=["a", "i", "x"])

    sums = {(r["a"], r["i"]): int(r["x"]) for r in small.mapInArrow(added, "a long, i long, x long").groupBy("a", "i").agg(F.sum("x").alias("x")).collect()}
    hot = {a: np.array([sums[a, i] for i in range(K + 2)]) for a, i in sums if a >= 0 and i == 0}
    return Katz(model, stored, discounts([sums.get((-1 - r, 0), 0) for r in range(K + 1)]), hot)


def scores(model: Katz, id_col: str = "doc_id") -> DataFrame:
    """(id, held_out, n_tokens, n_known, train_tokens, base_score, score) of every document of the table that was counted.

    base_score is that of P(w) alone.
    """
    total, rare_from, d, hot = model.words.total, len(model.words.hashes), model.d, model.hot
    many, most, n = model.words.sizes.many, model.words.sizes.docs, model.words.n
    kind = model.grams.schema["ids"].dataType.elementType.simpleString()

    def run(batches):
        held, size = [], 0

        def settled():
            """What is held, added up for each document: their numbers, and rows of log P, rare base, rare known."""
            uid, of = np.unique(np.concatenate([u for u, _ in held]), return_inverse=True)
            return uid, np.stack([np.bincount(of, weights=np.concatenate([x[i] for _, x in held]), minlength=len(uid)) for i in range(3)])

        def rows(uid, x, ids: pa.DataType):
            block = uid >> DOC_BITS
            cut = np.flatnonzero(np.diff(block, prepend=-1, append=-1))
            parts = [(int(block[i]), packed(uid[i:j] & (1 << DOC_BITS) - 1), x[:, i:j].tobytes(), None, None) for i, j in zip(cut, cut[1:])]
            kinds = pa.int64(), pa.binary(), pa.binary(), ids, pa.list_(pa.bool_())
            return pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*parts), kinds)], names=["block", "docs", "sums", "ids", "held"])

        for b in batches:
            of_ids, home = b.schema.field("ids").type, pc.equal(b["kind"], HOME)
            if pc.any(home).as_py():
                own = b.filter(home)
                block = pa.array([int(unpacked(x)[0]) >> DOC_BITS for x in own["docs"].to_pylist()], pa.int64())
                yield pa.RecordBatch.from_arrays([block, pa.nulls(len(block), pa.binary()), own["sums"], own["ids"], own["held"]], names=["block", "docs", "sums", "ids", "held"])
            for cells in zip(*(b.filter(pc.invert(home))[n].to_pylist() for n in ("v", "w", "c", "cw", "posts", "docs", "stats"))):
                v, w, count, cw, posts, docs, stats = map(unpacked, cells)
                stats, start = stats.reshape(-1, K + 2), np.flatnonzero(np.diff(v, prepend=-1))
                if hot:
                    stats = np.stack([hot.get(a, own) for a, own in zip(v[start].tolist(), stats)])
                log, rare = probabilities(count, cw, stats, np.cumsum(np.diff(v, prepend=v[0]) != 0), d, total, many), w >= rare_from
                held.append((docs, np.repeat(np.stack([log, np.where(rare, np.log10(cw + 1.0), 0), rare & (cw > 0)]), posts, axis=1)))
                size += len(docs)
                if size >= 2 * most:
                    done = settled()
                    held[:], size = [done], len(done[0])
                    if size >= most:
                        yield rows(*done, of_ids)
                        held.clear()
                        size = 0
        if size:
            yield rows(*settled(), of_ids)

    def whole(group: pa.Table) -> pa.Table:
        """A block's documents: what was scored at home and what came back from buckets."""
        at_home = group.filter(group["ids"].is_valid())
        sums = np.frombuffer(at_home["sums"][0].as_py()).reshape(4, -1).copy()
        back = group.filter(group["ids"].is_null())
        for docs, x in zip(back["docs"].to_pylist(), back["sums"].to_pylist()):
            sums[np.ix_([0, 1, 3], unpacked(docs))] += np.frombuffer(x).reshape(3, -1)
        score, base, tokens, known = sums
        columns = [at_home["ids"].combine_chunks().flatten(), at_home["held"].combine_chunks().flatten(), pa.array(tokens.astype(np.int64)), pa.array(known.round().astype(np.int64)), pa.array(np.full(len(score), n)), pa.array(base - tokens * np.log10(total)), pa.array(score)]
        return pa.table(columns, names=[id_col, "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"])

    # a task sends a row for each block that its contexts were met in, and up to sizes.docs documents at a time
    stored = model.grams.filter(F.col("kind").isin(HOME, PAIRS)).select("kind", "v", "w", "c", "cw", "posts", "docs", "stats", "ids", "held", "sums")
    parts = over_texts(stored, run, f"block long, docs binary, sums binary, ids array<{kind}>, held array<boolean>")
    return parts.groupBy("block").applyInArrow(whole, f"{id_col} {kind}, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")


def op13_lm(spark, sf_dir):
    """A null doc_id is not held out."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 7 == 2, F.lit(False))
    with scratch():
        return written(scores(fit(docs, ~held)), "scores", keep=True)


QUERIES = {"op13_lm": op13_lm}
ORACLES: dict[str, str] = {}

"""OCR layout: token filters, lines and regions from token geometry."""

from __future__ import annotations

from operator import itemgetter

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import ArrayType, StringType, StructField, StructType
from pyspark.sql.window import Window

from ..plans.register import Registry
from ..plans.views import view
from ..sources.readers import cached
from .boxes import KEPT_SQL, dedup_detections

register = Registry()
LEAST_CONFIDENCE, COLUMN_GAP = 0.3, 4.0


def tokens(docs: DataFrame) -> DataFrame:
    """A token table from a text's words: ten to a line, with a wider gap after each fifth line."""
    words = docs.select("doc_id", F.posexplode(F.filter(F.regexp_extract_all("text", F.lit(r"[^ \t\n\r]+"), F.lit(0)), lambda w: w != "")).alias("tok_no", "text"))
    i = F.col("tok_no")
    rows = words.select("doc_id", "tok_no", "text", (((F.col("doc_id") * 31 + i * 17) % 100) / 100).alias("confidence"), ((i % 10) * 50).cast("double").alias("xmin"), (20 * F.floor(i / 10) + 60 * F.floor(i / 50)).cast("double").alias("ymin"))
    return rows.withColumn("xmax", F.col("xmin") + 5.0 * F.length("text")).withColumn("ymax", F.col("ymin") + 12.0)


def filter_tokens(df: DataFrame) -> DataFrame:
    return df.filter((F.col("text") != "") & (F.col("confidence") > LEAST_CONFIDENCE))


def upper_median(array):
    """sorted[n div 2], the upper of two middle values."""
    return F.element_at(F.array_sort(array), F.floor(F.size(array) / 2).cast("int") + 1)


def cluster_regions(df: DataFrame) -> DataFrame:
    """Add region: a new one starts where the gap to the token before exceeds max(2 * median height, 30).

    Gaps and islands. The median is the height in the middle of a document's ranks, so all windows
    share one shuffle, nothing is joined and no array grows with the document.
    """
    doc = Window.partitionBy("doc_id")
    ranked = df.withColumn("h", F.greatest(F.lit(1.0), F.col("ymax") - F.col("ymin")))
    ranked = ranked.withColumn("r", F.row_number().over(doc.orderBy("h"))).withColumn("n", F.count(F.lit(1)).over(doc))
    ranked = ranked.withColumn("mh", F.max(F.when(F.col("r") == F.floor(F.col("n") / 2) + 1, F.col("h"))).over(doc)).drop("h", "r", "n")
    order = doc.orderBy("ymin", "xmin", "tok_no")
    gap = F.col("ymin") - F.lag("ymax").over(order)
    rows = ranked.withColumn("new", F.when(gap > F.greatest(2 * F.col("mh"), F.lit(30.0)), 1).otherwise(0))
    return rows.withColumn("region", F.sum("new").over(order)).drop("new", "mh")


LINE = ("text", "xmin", "ymin", "xmax", "ymax", "n_tokens")


def lines_of(token: list[tuple]) -> list[tuple]:
    """First-fit lines of some tokens (centre, xmin, tok_no, xmax, ymin, ymax, text), as rows of LINE.

    Tokens come in the order of their first three entries. A token joins the first line whose mean centre is
    within max(6, half the median height) and that is not farther than four heights aside. Each choice depends
    on those before. Centres rise, so a line that is once too far above is never looked at again: the work is
    linear but for lines side by side.
    """
    height = sorted(max(1.0, t[5] - t[4]) for t in token)[len(token) // 2]
    near, aside = max(6.0, height * 0.5), height * COLUMN_GAP
    lines, open_ = [], []
    for t in token:
        cy = t[0]
        open_ = [x for x in open_ if abs(cy - x[0] / len(x[3])) <= near]
        line = next((x for x in open_ if t[1] <= x[2] + aside and t[3] >= x[1] - aside), None)
        if line is None:
            line = [0.0, t[1], t[3], []]
            open_.append(line)
            lines.append(line)
        line[0], line[1], line[2] = line[0] + cy, min(line[1], t[1]), max(line[2], t[3])
        line[3].append(t)
    rows = []
    for _, low, high, held in lines:
        held.sort(key=itemgetter(1))
        rows.append((" ".join(t[6] for t in held), low, min(t[4] for t in held), high, max(t[5] for t in held), len(held)))
    rows.sort(key=lambda r: ((r[2] + r[4]) / 2, r[1]))
    return rows


TOKEN = ("cy", "xmin", "tok_no", "xmax", "ymin", "ymax", "text")


def by_group(df: DataFrame, keys: list[str], fold, schema: str) -> DataFrame:
    """Rows that fold(key, tokens) gives for each group of tokens, tokens as lines_of takes them. Keys are longs; null ones are kept.

    Groups are small and many, so they are not sent one by one: partitions come sorted, an Arrow batch is cut where
    the keys change, and only a group that goes on in the next batch is held back.
    """
    shape = pa.schema([(f.name, to_arrow_type(f.dataType)) for f in StructType.fromDDL(schema)])

    def groups(batches):
        open_, held = None, []
        for b in batches:
            columns = [c.to_pylist() for c in b.columns]
            key = list(zip(*columns[: len(keys)]))
            token = list(zip(*columns[len(keys) :]))
            ends = [i for i in range(1, len(key)) if key[i] != key[i - 1]] + [len(key)]
            begin, rows = 0, []
            for end in ends:
                if begin == end:
                    continue
                if held and key[begin] != open_:
                    rows += fold(open_, held)
                    held = []
                open_ = key[begin]
                held += token[begin:end]
                begin = end
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), shape.types)], schema=shape)
        rows = fold(open_, held) if held else []
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), shape.types)], schema=shape)

    centre = ((F.col("ymin") + F.col("ymax")) / 2).alias("cy")
    typed = df.select(*(F.col(k).cast("long").alias(k) for k in keys), centre, *TOKEN[1:])
    return typed.repartition(*keys).sortWithinPartitions(*keys, *TOKEN[:3]).mapInArrow(groups, schema)


def group_lines(df: DataFrame) -> DataFrame:
    """(doc_id, line_no, text, box, n_tokens): the lines of each document.

    A document is one sequential group; documents are dealt out by hash.
    """

    def fold(key, token):
        return [(*key, i, *line) for i, line in enumerate(lines_of(token))]

    return by_group(df, ["doc_id"], fold, "doc_id long, line_no long, text string, xmin double, ymin double, xmax double, ymax double, n_tokens long")


def lines_within(df: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, xmin, ymin, xmax, ymax, n_tokens, lines) for each group of tokens: its box, and its lines found among its own tokens.

    Lines that are blank go, and groups without a line left. Keys are longs; null ones are kept.
    """

    def fold(key, token):
        lines = [r[0] for r in lines_of(token) if r[0].strip()]
        box = (min(t[1] for t in token), min(t[4] for t in token), max(t[3] for t in token), max(t[5] for t in token))
        return [(*key, *box, len(token), lines)] if lines else []

    return by_group(df, keys, fold, ", ".join(f"{k} long" for k in keys) + ", xmin double, ymin double, xmax double, ymax double, n_tokens long, lines array<string>")


def region_bbox(df: DataFrame) -> DataFrame:
    """Box, text and line count of each region; its lines are grouped within it, and regions without text go."""
    made = lines_within(cluster_regions(df), ["doc_id", "region"])
    return made.select("doc_id", "region", "xmin", "ymin", "xmax", "ymax", "n_tokens", F.array_join("lines", "\n").alias("text"), F.size("lines").alias("line_count"))


_T = """select doc_id, tok_no, text, cast((doc_id * 31 + tok_no * 17) % 100 as double) / 100 as confidence, cast((tok_no % 10) * 50 as double) as xmin, cast((tok_no % 10) * 50 as double) + 5.0 * length(text) as xmax,
 cast(20 * (tok_no // 10) + 60 * (tok_no // 50) as double) as ymin, cast(20 * (tok_no // 10) + 60 * (tok_no // 50) as double) + 12.0 as ymax
 from (select doc_id, unnest(regexp_extract_all(text, '[^ \\t\\n\\r]+')) as text, unnest(range(len(regexp_extract_all(text, '[^ \\t\\n\\r]+')))) as tok_no from documents)"""
_K = f"select * from ({_T}) where confidence > 0.3"
_R = f"select doc_id, tok_no, xmin, xmax, ymin, ymax, sum(case when ymin - p > 30 then 1 else 0 end) over (partition by doc_id order by ymin, xmin, tok_no) as region from (select *, lag(ymax) over (partition by doc_id order by ymin, xmin, tok_no) as p from ({_K}))"

#: Lines of tokens at one height, 12 high: first fit starts another where the gap to all before exceeds four heights.
_LINES_SQL = """(select {keys}, ymin, min(xmin) as xmin, max(xmax) as xmax, max(ymax) as ymax, string_agg(text, ' ' order by xmin, tok_no) as text, count(*) as n from (
 select *, sum(case when xmin > before + 48 then 1 else 0 end) over (partition by {keys}, ymin order by xmin, tok_no) as island from (
  select *, max(xmax) over (partition by {keys}, ymin order by xmin, tok_no rows between unbounded preceding and 1 preceding) as before from ({of}))) group by {keys}, ymin, island)"""


def _tok(spark, sf):
    return filter_tokens(tokens(view(spark, sf, "documents")))


@register("scan_tokens", f"select doc_id, tok_no, text, confidence, xmin, ymin, xmax, ymax from ({_T})")
def scan_tokens(spark, sf):
    return tokens(view(spark, sf, "documents")).select("doc_id", "tok_no", "text", "confidence", "xmin", "ymin", "xmax", "ymax")


@register("filter_tokens", f"select doc_id, tok_no from ({_K})")
def q_filter_tokens(spark, sf):
    return _tok(spark, sf).select("doc_id", "tok_no")


@register("token_geometry", f"select doc_id, tok_no, (xmin + xmax) / 2 as center_x, (ymin + ymax) / 2 as center_y, greatest(1.0, ymax - ymin) as height from ({_K})")
def token_geometry(spark, sf):
    return _tok(spark, sf).select("doc_id", "tok_no", ((F.col("xmin") + F.col("xmax")) / 2).alias("center_x"), ((F.col("ymin") + F.col("ymax")) / 2).alias("center_y"), F.greatest(F.lit(1.0), F.col("ymax") - F.col("ymin")).alias("height"))


@register("upper_median_height", f"select doc_id, list_extract(list_sort(list(xmax - xmin)), cast(count(*) // 2 + 1 as int)) as median from ({_K}) group by doc_id")
def upper_median_height(spark, sf):
    return _tok(spark, sf).groupBy("doc_id").agg(upper_median(F.collect_list(F.col("xmax") - F.col("xmin"))).alias("median"))


@register("cluster_regions_by_gap", f"select doc_id, tok_no, region from ({_R})")
def cluster_regions_by_gap(spark, sf):
    return cluster_regions(_tok(spark, sf)).select("doc_id", "tok_no", "region")


@register("region_bbox", f"select doc_id, region, min(xmin) as xmin, min(ymin) as ymin, max(xmax) as xmax, max(ymax) as ymax, cast(sum(n) as bigint) as n_tokens, string_agg(text, chr(10) order by ymin, xmin) as text, count(*) as line_count from {_LINES_SQL.format(keys='doc_id, region', of=f'select k.*, r.region from ({_K}) k join ({_R}) r using (doc_id, tok_no)')} group by doc_id, region")
def q_region_bbox(spark, sf):
    return region_bbox(_tok(spark, sf))


@register("group_lines", f"select doc_id, row_number() over (partition by doc_id order by ymin, xmin) - 1 as line_no, text, xmin, ymin, xmax, ymax, n_tokens from (select doc_id, min(xmin) as xmin, ymin, max(xmax) as xmax, max(ymax) as ymax, string_agg(text, ' ' order by xmin, tok_no) as text, count(*) as n_tokens from ({_T}) group by doc_id, ymin)")
def q_group_lines(spark, sf):
    """The truth corpus puts a line's tokens at one height, closer than four heights, so lines are known."""
    return group_lines(tokens(view(spark, sf, "documents")))


@register("line_bbox", f"select doc_id, ymin, xmin, xmax, ymax, text from {_LINES_SQL.format(keys='doc_id', of=_K)}")
def line_bbox(spark, sf):
    """Tokens of low confidence are gone, so wide gaps cut rows into several lines."""
    return group_lines(_tok(spark, sf)).select("doc_id", "ymin", "xmin", "xmax", "ymax", "text")


@register("raw_text", "select doc_id, string_agg(text, chr(10) order by line_no) as raw_text from v_invoice_lines group by doc_id")
def raw_text(spark, sf):
    return view(spark, sf, "v_invoice_lines").groupBy("doc_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line_no", "text"))), lambda r: r["text"]), "\n").alias("raw_text"))


BLOCK = 64


def tokens_in_boxes(boxes: DataFrame, tokens: DataFrame, block: int = BLOCK) -> DataFrame:
    """Tokens (doc_id, tok_no, text, box) with each box (image_id, region_index, x1, y1, x2, y2) that holds their centre, borders included.

    Both sides are dealt out by image, tokens once and without copies. An image's boxes stand in arrays of at most
    `block`, from above; a token meets an array only within its extent and is tested there with each box, in passing:
    nothing is shuffled after that. A token in several boxes comes once for each.
    """
    fit = boxes.filter("x1 <= x2 and y1 <= y2").select("image_id", "region_index", "x1", "y1", "x2", "y2")
    place = F.row_number().over(Window.partitionBy("image_id").orderBy("y1", "region_index"))
    held = fit.withColumn("k", F.floor((place - 1) / block)).groupBy("image_id", "k").agg(F.collect_list(F.struct("region_index", "x1", "y1", "x2", "y2")).alias("b"), *(f(c).alias(f"_{c}") for f, c in ((F.min, "x1"), (F.min, "y1"), (F.max, "x2"), (F.max, "y2"))))
    mx, my = (F.col("xmin") + F.col("xmax")) / 2, (F.col("ymin") + F.col("ymax")) / 2
    dealt = tokens.select(F.col("doc_id").alias("image_id"), "tok_no", "text", "xmin", "ymin", "xmax", "ymax")
    met = dealt.join(held.hint("merge"), "image_id").filter(mx.between(F.col("_x1"), F.col("_x2")) & my.between(F.col("_y1"), F.col("_y2")))
    each = met.select("image_id", "tok_no", "text", "xmin", "ymin", "xmax", "ymax", F.explode("b").alias("b"))
    return each.filter(mx.between(F.col("b.x1"), F.col("b.x2")) & my.between(F.col("b.y1"), F.col("b.y2"))).select("image_id", "b.region_index", "tok_no", "text", "xmin", "ymin", "xmax", "ymax")


def lines_of_groups(df: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, lines) for each group of tokens, as lines_within finds them, where the groups are already together: each comes as one row, without a shuffle of its own."""
    token = F.struct(((F.col("ymin") + F.col("ymax")) / 2).alias("cy"), *TOKEN[1:])
    rows = df.groupBy(*keys).agg(F.array_sort(F.collect_list(token)).alias("t"))

    def run(batches):
        for b in batches:
            t = b.column(len(keys))
            tokens, sizes, lines, at = list(zip(*(c.to_pylist() for c in t.flatten().flatten()))), t.value_lengths().to_pylist(), [], 0
            for n in sizes:
                lines.append([r[0] for r in lines_of(tokens[at : at + n]) if r[0].strip()])
                at += n
            yield pa.RecordBatch.from_arrays([*b.columns[: len(keys)], pa.array(lines, pa.list_(pa.string()))], names=[*keys, "held"])

    kept = rows.select(*keys).schema
    return rows.mapInArrow(run, StructType([*kept.fields, StructField("held", ArrayType(StringType()))]))


def detect_to_regions(boxes: DataFrame, tokens: DataFrame) -> DataFrame:
    """(image_id, region_index, det_no, label, lines, text, payload): boxes without doubles, with the lines of the tokens whose centre they hold.

    Lines are found among a box's own tokens. A box without tokens stays, with no lines.
    """
    kept = cached(dedup_detections(boxes), "kept")
    made = lines_of_groups(tokens_in_boxes(kept, tokens), ["image_id", "region_index"]).filter(F.size("held") > 0)
    rows = kept.join(made.hint("merge"), ["image_id", "region_index"], "left").withColumn("held", F.coalesce("held", F.array().cast("array<string>")))
    payload = F.to_json(F.struct("region_index", "label", F.col("held").alias("lines")))
    return rows.select("image_id", "region_index", "det_no", "label", F.size("held").alias("lines"), F.array_join("held", "\n").alias("text"), payload.alias("payload"))


_BOXED = f"select d.image_id, d.region_index, d.det_no, d.label, t.tok_no, t.text, t.xmin, t.ymin, t.xmax, t.ymax from ({KEPT_SQL}) d join v_page_tokens t on t.doc_id = d.image_id and (t.xmin + t.xmax) / 2 between d.x1 and d.x2 and (t.ymin + t.ymax) / 2 between d.y1 and d.y2"


@register("tokens_in_boxes", f"select image_id, region_index, tok_no from ({_BOXED})")
def q_tokens_in_boxes(spark, sf):
    return tokens_in_boxes(dedup_detections(view(spark, sf, "v_detections")), view(spark, sf, "v_page_tokens")).select("image_id", "region_index", "tok_no")


@register("detect_to_regions", f"""select d.image_id, d.region_index, d.det_no, d.label, coalesce(n, 0) as lines, coalesce(l.text, '') as text,
 '{{"region_index":' || d.region_index || ',"label":"' || d.label || '","lines":[' || coalesce(quoted, '') || ']}}' as payload
 from ({KEPT_SQL}) d left join (select image_id, region_index, count(*) as n, string_agg(text, chr(10) order by ymin, xmin) as text, string_agg('"' || text || '"', ',' order by ymin, xmin) as quoted
  from {_LINES_SQL.format(keys='image_id, region_index', of=_BOXED)} group by image_id, region_index) l on l.image_id = d.image_id and l.region_index = d.region_index""")
def q_detect_to_regions(spark, sf):
    return detect_to_regions(view(spark, sf, "v_detections"), view(spark, sf, "v_page_tokens"))


@register("join_neighbor_lines", "select doc_id, line_no, lag(text) over w as before, lead(text) over w as after, lead(text, 4) over w as fourth from v_invoice_lines window w as (partition by doc_id order by line_no)")
def join_neighbor_lines(spark, sf):
    w = Window.partitionBy("doc_id").orderBy("line_no")
    return view(spark, sf, "v_invoice_lines").select("doc_id", "line_no", F.lag("text").over(w).alias("before"), F.lead("text").over(w).alias("after"), F.lead("text", 4).over(w).alias("fourth"))


@register("nearby_lines", "select a.doc_id, a.line_no, b.line_no as near_no from (select doc_id, line_no, unnest([1, 2]) as k from v_invoice_lines) a join v_invoice_lines b on b.doc_id = a.doc_id and b.line_no = a.line_no + k where 20 * k <= 12 * (1.5 + k)")
def nearby_lines(spark, sf):
    """Lines one or two further whose distance is at most height * (1.5 + offset)."""
    w = Window.partitionBy("doc_id").orderBy("line_no")
    rows = view(spark, sf, "v_invoice_lines").select("doc_id", "line_no", F.lead("line_no", 1).over(w).alias("n1"), F.lead("line_no", 2).over(w).alias("n2"))
    rows = rows.select("doc_id", "line_no", F.explode(F.array(F.struct(F.lit(1).alias("k"), F.col("n1").alias("n")), F.struct(F.lit(2).alias("k"), F.col("n2").alias("n")))).alias("o"))
    return rows.filter((F.col("o.n") - F.col("line_no") == F.col("o.k")) & (20 * (F.col("o.n") - F.col("line_no")) <= 12 * (1.5 + F.col("o.k")))).select("doc_id", "line_no", F.col("o.n").alias("near_no"))


@register("explode_lines", "select doc_id, region, trim(text) as line from v_invoice_lines where trim(text) <> ''")
def explode_lines(spark, sf):
    """Region rows with line arrays -> stripped non-blank lines."""
    regions = view(spark, sf, "v_invoice_lines").groupBy("doc_id", "region").agg(F.collect_list("text").alias("lines"))
    return regions.select("doc_id", "region", F.explode(F.filter(F.transform("lines", lambda x: F.trim(x)), lambda x: x != "")).alias("line"))


QUERIES, ORACLES = register.queries, register.oracles

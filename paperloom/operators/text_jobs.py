"""Text functions delivered as jobs over whole tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import text as X
from ..plans.register import Registry
from ..plans.views import view
from ..sources.scratch import new_path
from ..sources.truth import is_blank, truth_map

register = Registry()
_CLEAN = "array_to_string(list_filter(string_split(trim(regexp_replace(regexp_replace(text, '[^\\x00-\\x7F]', '', 'g'), '[\\s\\x0b\\x1c-\\x1f]+', ' ', 'g')), ' '), lambda t: length(t) > 1 or regexp_full_match(t, '[0-9]')), ' ')"
_ASCII = "regexp_replace(translate(text, 'àáâãäåçèéêëìíîïñòóôõöùúûüýÿÀÁÂÃÄÅÇÈÉÊËÌÍÎÏÑÒÓÔÕÖÙÚÛÜÝ', 'aaaaaaceeeeiiiinooooouuuuyyAAAAAACEEEEIIIINOOOOOUUUUY'), '[^\\x00-\\x7F]', '', 'g')"
_NORM = f"trim(regexp_replace(regexp_replace(lower({_ASCII}), '[^a-z0-9%@./,_#:$+\\- ]+', ' ', 'g'), ' +', ' ', 'g'))"
_DATE = "\\b(?:\\d{1,2}[/-]\\d{1,2}[/-]\\d{2,4}|\\d{4}[/-]\\d{1,2}[/-]\\d{1,2}|\\d{1,2}\\s+[A-Za-z]{3,9}\\s+\\d{2,4}|[A-Za-z]{3,9}\\s+\\d{1,2},\\s+\\d{4})\\b"
_PHONE = "(?:(?:\\+\\d{1,3}[\\s.-]?)?(?:\\(?\\d{2,4}\\)?[\\s.-]?){2,5}\\d{2,4})"
_PHONES = f"list_filter(list_transform(regexp_extract_all(text, '{_PHONE}'), lambda c: trim(c)), lambda c: length(regexp_replace(c, '\\D', '', 'g')) >= 8)"
_EMAIL = "(?i)\\b[A-Z0-9._%+-]+@[A-Z0-9.-]+\\.[A-Z]{2,}\\b"
_FOUND_EMAIL = f"nullif(regexp_extract(text, '{_EMAIL}'), '')"


def phrases(name: str, expr, sql: str):
    """A function over the phrase table."""

    @register(name, f"select id, {sql} as value from v_phrases")
    def job(spark, sf):
        return view(spark, sf, "v_phrases").select("id", expr(F.col("text")).alias("value"))


phrases("is_postal_code", X.is_postal_code, "regexp_matches(trim(text), '(?i)^(?:[A-Z]{1,2}\\d{1,2}[A-Z]?\\s*\\d[A-Z]{2}|\\d{5}(?:-\\d{4})?|[A-Z]\\d[A-Z]\\s*\\d[A-Z]\\d|\\d{4,5})$')")
phrases("looks_like_phone", X.looks_like_phone, "starts_with(text, '+') or (length(regexp_replace(text, '\\D', '', 'g')) >= 8 and regexp_full_match(text, '[\\d().+\\-\\s]+'))")
phrases("is_street_line", X.is_street_line, "regexp_matches(text, '(?i)\\b(lane|ln|street|st|avenue|ave|road|rd|drive|dr|blvd|boulevard|court|ct|place|pl|way|circle|cir)\\b')")
phrases("is_header_line", X.is_header_line, "length(regexp_replace(text, '[^A-Za-z]', '', 'g')) > 0 and length(regexp_replace(text, '[^A-Z]', '', 'g')) > 0.8 * length(regexp_replace(text, '[^A-Za-z]', '', 'g')) and len(string_split(trim(text), ' ')) >= 2")
phrases("find_percent", lambda t: F.trim(X.first(t, X.PERCENT)), "nullif(regexp_extract(text, '\\b\\d{1,2}(?:[.,]\\d{1,2})?\\s*%'), '')")
phrases("first_date", lambda t: X.first(t, X.DATE), f"nullif(regexp_extract(text, '(?i){_DATE}'), '')")
phrases("find_email", X.find_email, f"case when {_FOUND_EMAIL} is not null then replace({_FOUND_EMAIL}, '.con', '.com') else nullif(regexp_extract(replace(regexp_replace(text, '\\s+', '', 'g'), '.con', '.com'), '{_EMAIL}'), '') end")
phrases("invoice_id_candidates", lambda t: F.array_join(X.invoice_id_candidates(t), ","), "array_to_string(list_filter(regexp_extract_all(text, '(?i)\\b[A-Z0-9][A-Z0-9./_-]{3,}\\b'), lambda t: length(regexp_replace(t, '\\D', '', 'g')) >= 4), ',')")
phrases("looks_like_table_header", lambda t: X.looks_like_table_header(X.normalize_text(t)), f"{' + '.join(f'cast(contains({_NORM}, {chr(39)}{h}{chr(39)}) as int)' for h in X.TABLE_HEADER)} >= 3")
phrases("contains_anchor", lambda t: X.contains_anchor(X.normalize_text(t), "invoice"), f"contains(' ' || {_NORM} || ' ', ' invoice ')")
phrases("strip_anchor_prefix", lambda t: X.strip_anchor_prefix(t, ("ref", "total ttc")), f"case when regexp_matches(text, '[:-]') and regexp_matches(lower(regexp_extract(text, '^[^:-]*')), 'ref|total ttc') then trim(regexp_replace(text, '^[^:-]*[:-]', '')) else text end")
phrases("regex_or_strip", lambda t: X.regex_or_strip(F.concat(F.lit(" :"), t, F.lit("- ")), None), "trim(text, ' :-')")
phrases("strip_product_noise", X.strip_product_noise, f"nullif(trim(regexp_replace(regexp_replace(trim(case when regexp_matches(text, '(?i){_DATE}') then regexp_replace(text, '(?is){_DATE}.*$', '') else text end, ' :-'), '\\s{{2,}}', ' ', 'g'), '(?:\\b\\d+[.,]?\\d*\\b\\s*){{2,}}$', ''), ' :-'), '')")
phrases("clean_invoice_number", X.clean_invoice_number, "trim(regexp_replace(regexp_replace(trim(text), '\\s*([/._-])\\s*', ' \\1 ', 'g'), '\\s+', ' ', 'g'), ' -:#')")
phrases("infer_currency", X.infer_currency, "case when contains(text, '€') or contains(upper(text), 'EUR') then 'EUR' when contains(text, '$') or contains(upper(text), 'USD') then 'USD' when contains(text, '£') or contains(upper(text), 'GBP') then 'GBP' else '' end")
phrases("intersect_chars", lambda t: t.rlike(r"[+\-(). ]"), "regexp_matches(text, '[+\\-(). ]')")
phrases("drop_noise_lines", lambda t: ~X.any_in(X.normalize_text(t), X.PRODUCT_NOISE), f"not regexp_matches({_NORM}, '{'|'.join(X.PRODUCT_NOISE)}')")
phrases("find_phone", X.find_phone, f"case when contains({_NORM}, 'nif') then null else list_extract({_PHONES}, 1) end")


@register("clean_ocr_text", f"select doc_id, {_CLEAN} as cleaned from documents")
def clean_ocr_text(spark, sf):
    return view(spark, sf, "documents").select("doc_id", X.clean_ocr_text(F.col("text")).alias("cleaned"))


@register("normalize_text", f"select doc_id, {_NORM} as normalized from documents")
def normalize_text(spark, sf):
    return view(spark, sf, "documents").select("doc_id", X.normalize_text(F.col("text")).alias("normalized"))


@register("keyword_counts", "select doc_id, " + ", ".join(" + ".join(f"cast(contains(lower(text), '{w}') as int)" for w in ws) + f" as {n}" for n, ws in X.KEYWORDS.items()) + " from documents")
def keyword_counts(spark, sf):
    return view(spark, sf, "documents").select("doc_id", *(c.alias(n) for n, c in X.keyword_counts(F.col("text")).items()))


_WORDS = f"list_filter(string_split({_CLEAN}, ' '), lambda w: w <> '')"
_LINES = "string_split(trim(text, ' ' || chr(9) || chr(10) || chr(13)), chr(10))"
_META = f"""select doc_id, length(text) as n_chars, len({_WORDS}) as n_words, len({_LINES}) as n_lines,
 round(case when len({_WORDS}) = 0 then 0.0 else list_sum(list_transform({_WORDS}, lambda w: length(w))) / len({_WORDS}) end, 9) as avg_word_len,
 round(list_sum(list_transform({_LINES}, lambda w: length(w))) / len({_LINES}), 9) as avg_line_len,
 round(length(regexp_replace(text, '[^\\p{{Nd}}]', '', 'g')) / greatest(length(text), 1), 9) as digit_ratio,
 round(length(regexp_replace(text, '[^\\p{{Lu}}]', '', 'g')) / greatest(length(text), 1), 9) as upper_ratio,
 round(length(regexp_replace(text, '[\\p{{L}}\\p{{N}}\\p{{M}}\\s]', '', 'g')) / greatest(length(text), 1), 9) as special_ratio,
 {", ".join(" + ".join(f"cast(contains(lower(text), '{w}') as int)" for w in ws) + f" as {n}" for n, ws in X.KEYWORDS.items())},
 cast(contains(text, '@') as double) as has_at, cast(regexp_matches(text, '[$€£]') as double) as has_currency, cast(regexp_matches(text, '\\b\\d{{1,2}}[/-]\\d{{1,2}}[/-]\\d{{2,4}}\\b') as double) as has_date from documents"""


META = ("n_chars", "n_words", "n_lines", "avg_word_len", "avg_line_len", "digit_ratio", "upper_ratio", "special_ratio", *X.KEYWORDS, "has_at", "has_currency", "has_date")


def meta_features(docs: DataFrame, *keep: str) -> DataFrame:
    rounded = lambda n, c: F.round(c, 9).alias(n) if n.startswith("avg") or n.endswith("ratio") else c.alias(n)
    return docs.select(*(keep or ("doc_id",)), *(rounded(n, c) for n, c in X.text_meta_features(F.col("text")).items()))


@register("text_meta_features", _META)
def text_meta_features(spark, sf):
    return meta_features(view(spark, sf, "documents"))


@register("job_text_features", _META)
def job_text_features(spark, sf):
    """The 15-column feature table: one projection, no shuffle."""
    return meta_features(view(spark, sf, "documents"))


@register("job_clean_corpus", f"select lang, source, count(*) as docs, cast(sum(len({_WORDS})) as bigint) as words, cast(sum(length({_NORM})) as bigint) as chars from documents group by lang, source")
def job_clean_corpus(spark, sf):
    words = F.size(F.filter(F.split(X.clean_ocr_text(F.col("text")), " "), lambda w: w != ""))
    return view(spark, sf, "documents").groupBy("lang", "source").agg(F.count(F.lit(1)).alias("docs"), F.sum(words).cast("long").alias("words"), F.sum(F.length(X.normalize_text(F.col("text")))).cast("long").alias("chars"))


@register("find_dates", f"select doc_id, line_no, nullif(regexp_extract(text, '(?i){_DATE}'), '') as date_text from v_invoice_lines")
def find_dates(spark, sf):
    return view(spark, sf, "v_invoice_lines").select("doc_id", "line_no", X.first(F.col("text"), X.DATE).alias("date_text"))


_LAST = "case when line_no = 1 then substr(text, 17) when line_no = 2 then right(text, 4) when line_no = 100 then substr(text, 8) when line_no between 6 and 99 then (case when length(split_part(text, ' ', 2)) <= 3 then substr(text, 6) else split_part(text, ' ', 3) end) end"


@register("find_amounts", f"select doc_id, line_no, {_LAST} as amount from v_invoice_lines")
def find_amounts(spark, sf):
    """The last amount of each line. Up to three capital letters before a number belong to it."""
    return view(spark, sf, "v_invoice_lines").select("doc_id", "line_no", X.last(F.col("text"), X.MONEY).alias("amount"))


@register("invoice_number_from_text", "select doc_id, line_no, case when line_no = 1 then lower(substr(text, 13)) when line_no = 2 then substr(text, 7) when line_no = 100 then (case when length(text) < 16 then substr(text, 8) end) when line_no between 6 and 99 and length(split_part(text, ' ', 3)) < 9 then split_part(text, ' ', 3) end as number from v_invoice_lines")
def invoice_number_from_text(spark, sf):
    """On every line; an amount of eight digits and more passes for a phone."""
    return view(spark, sf, "v_invoice_lines").select("doc_id", "line_no", X.invoice_number(F.col("text")).alias("number"))


KINDS = {
    "email": lambda t: X.every(t, X.EMAIL),
    "phone": lambda t: F.filter(X.every(t, X.PHONE), lambda c: X.digits(c) >= 8),
    "date": lambda t: X.every(t, X.DATE),
    "percent": lambda t: X.every(t, X.PERCENT),
    "invoice_id": X.invoice_id_candidates,
    "amount": lambda t: X.every(t, X.MONEY),
}


def mentions(rows: DataFrame, *kinds: str) -> DataFrame:
    """(doc_id, source, kind, pos, value): what each text mentions, numbered from 0 in a text by kind; all KINDS unless named."""
    found = [F.struct(F.lit(k).alias("kind"), KINDS[k](F.col("text")).alias("values")) for k in kinds or KINDS]
    each = rows.select("doc_id", "source", F.explode(F.array(*found)).alias("f")).select("doc_id", "source", "f.*")
    return each.select("doc_id", "source", "kind", F.posexplode("values").alias("pos", "value"))


_TEXTS = "select source, text from documents union all select 'conversations', text from conversations"
_MENTIONS = {"email": f"regexp_extract_all(text, '{_EMAIL}')", "phone": _PHONES, "date": f"regexp_extract_all(text, '(?i){_DATE}')", "percent": "regexp_extract_all(text, '\\b\\d{1,2}(?:[.,]\\d{1,2})?\\s*%')",
             "invoice_id": "list_filter(regexp_extract_all(text, '(?i)\\b[A-Z0-9][A-Z0-9./_-]{3,}\\b'), lambda t: length(regexp_replace(t, '\\D', '', 'g')) >= 4)"}


@register("job_contact_scan", "select source, kind, cast(sum(n) as bigint) as mentions, count(*) as texts from (" + " union all ".join(f"select source, '{k}' as kind, len({v}) as n from ({_TEXTS})" for k, v in _MENTIONS.items()) + ") where n > 0 group by source, kind")
def job_contact_scan(spark, sf):
    """Mentions by source and kind, over documents and turns. Amounts, whose pattern looks around, are left to `mentions`: no SQL states them."""
    docs, turns = view(spark, sf, "documents").select("doc_id", "source", "text"), view(spark, sf, "conversations").select(F.col("conv_id").alias("doc_id"), F.lit("conversations").alias("source"), "text")
    found = mentions(docs.union(turns), *_MENTIONS)
    return found.groupBy("source", "kind").agg(F.count(F.lit(1)).alias("mentions"), F.count_if(F.col("pos") == 0).alias("texts"))


_PARSED = "coalesce(try_strptime(answer, '%d/%m/%Y'), try_strptime(answer, '%Y-%m-%d'))"
_AMOUNT = "try_cast(case when regexp_full_match(t, '\\d+,\\d{2}') then replace(t, ',', '.') else replace(t, ',', '') end as decimal(14,2))"


@register("parse_date", f"select doc_id, field, cast({_PARSED} as date) as parsed from v_answers where field in ('Invoice_Date', 'Due_Date', 'Client_Name')")
def parse_date(spark, sf):
    return view(spark, sf, "v_answers").filter(F.col("field").isin("Invoice_Date", "Due_Date", "Client_Name")).select("doc_id", "field", X.parse_date(F.col("answer")).alias("parsed"))


@register("parse_amount_decimal", f"select doc_id, q_rank, {_AMOUNT} as amount from (select *, regexp_replace(answer, '[€$£\\s]', '', 'g') as t from v_qa where field = 'Total')")
def parse_amount_decimal(spark, sf):
    return view(spark, sf, "v_qa").filter("field = 'Total'").select("doc_id", "q_rank", X.parse_amount_decimal(F.col("answer")).alias("amount"))


@register("parse_amount_float", "select doc_id, q_rank, try_cast(replace(regexp_replace(answer, '[A-Za-z€$£\\s]', '', 'g'), ',', '.') as double) as amount from v_qa where field = 'Total'")
def parse_amount_float(spark, sf):
    return view(spark, sf, "v_qa").filter("field = 'Total'").select("doc_id", "q_rank", X.parse_amount_float(F.col("answer")).alias("amount"))


@register("parse_amount_legacy", "select doc_id, q_rank, try_cast(replace(regexp_replace(answer, '\\s+', '', 'g'), ',', '') as double) as amount from v_qa where field = 'Total'")
def parse_amount_legacy(spark, sf):
    return view(spark, sf, "v_qa").filter("field = 'Total'").select("doc_id", "q_rank", X.parse_amount_legacy(F.col("answer")).alias("amount"))


# question-answer candidates

QA_LEAST = 0.05
FIELDS = {"Invoice_Number": "invoice_number", "Invoice_Date": "invoice_date", "Due_Date": "due_date", "Issuer_Name": "issuer_name", "Client_Name": "recipient_name", "Total": "total_amount"}


def confident(answers: DataFrame) -> DataFrame:
    return answers.filter((F.trim("answer") != "") & (F.col("score") >= QA_LEAST))


def qa_first_confident(answers: DataFrame) -> DataFrame:
    """Per document and field the first question, in order, whose answer passes."""
    return confident(answers).groupBy("doc_id", "field").agg(F.min_by("answer", "q_rank").alias("answer"))


def typed_output(answers: DataFrame) -> DataFrame:
    """Six typed columns, currency of the total, and how many fields have a value."""
    return typed(qa_first_confident(answers).groupBy("doc_id").pivot("field", list(FIELDS)).agg(F.first("answer")))


def typed(wide: DataFrame, *more: Column) -> DataFrame:
    """Typed columns from an answer column for each field."""
    text = lambda f: F.coalesce(f, F.lit(""))
    known = reduce(lambda a, b: a + b, (F.when(text(f) != "", 0.8).otherwise(0.0) for f in FIELDS))
    return wide.select("doc_id", text("Invoice_Number").alias("invoice_number"), X.parse_date(F.col("Invoice_Date")).alias("invoice_date"), X.parse_date(F.col("Due_Date")).alias("due_date"), text("Issuer_Name").alias("issuer_name"), text("Client_Name").alias("recipient_name"), X.parse_amount_decimal(F.col("Total")).alias("total_amount"), X.infer_currency(F.col("Total")).alias("currency"), F.round(known / len(FIELDS), 6).alias("mean_confidence"), *more)


_FIRST = f"select doc_id, field, answer from (select *, row_number() over (partition by doc_id, field order by q_rank) as k from v_qa where trim(answer) <> '' and score >= {QA_LEAST}) where k = 1"
_A = lambda f: f"max(answer) filter (field = '{f}')"
_TYPED = f"""select doc_id, coalesce(n, '') as invoice_number, cast(coalesce(try_strptime(d, '%d/%m/%Y'), try_strptime(d, '%Y-%m-%d')) as date) as invoice_date,
 cast(coalesce(try_strptime(u, '%d/%m/%Y'), try_strptime(u, '%Y-%m-%d')) as date) as due_date, coalesce(i, '') as issuer_name, coalesce(c, '') as recipient_name,
 try_cast(replace(regexp_replace(t, '[€$£\\s]', '', 'g'), ',', '') as decimal(14,2)) as total_amount,
 case when contains(t, '€') or contains(t, 'EUR') then 'EUR' when contains(t, '$') then 'USD' else '' end as currency,
 round((case when coalesce(n, '') <> '' then 0.8::double else 0 end + case when coalesce(d, '') <> '' then 0.8::double else 0 end + case when coalesce(u, '') <> '' then 0.8::double else 0 end + case when coalesce(i, '') <> '' then 0.8::double else 0 end + case when coalesce(c, '') <> '' then 0.8::double else 0 end + case when coalesce(t, '') <> '' then 0.8::double else 0 end) / 6, 6) as mean_confidence
 from (select doc_id, {_A('Invoice_Number')} as n, {_A('Invoice_Date')} as d, {_A('Due_Date')} as u, {_A('Issuer_Name')} as i, {_A('Client_Name')} as c, {_A('Total')} as t from ({_FIRST}) group by doc_id)"""


@register("qa_min_score", f"select doc_id, field, q_rank from v_qa where trim(answer) <> '' and score >= {QA_LEAST}")
def qa_min_score(spark, sf):
    return confident(view(spark, sf, "v_qa")).select("doc_id", "field", "q_rank")


@register("qa_first_confident", _FIRST)
def q_first_confident(spark, sf):
    return qa_first_confident(view(spark, sf, "v_qa"))


@register("qa_merge_typed_output", _TYPED)
def qa_merge_typed_output(spark, sf):
    return typed_output(view(spark, sf, "v_qa"))


_REASONS = "concat_ws(',', " + ", ".join(f"case when {c} is null then '{FIELDS[f]}: not answered' end" for c, f in zip("nduict", FIELDS)) + ", case when d is not null and invoice_date is null then 'invoice_date: not a date' end, case when u is not null and due_date is null then 'due_date: not a date' end, case when t is not null and total_amount is null then 'total_amount: not an amount' end)"


def typed_and_rejected(answers: DataFrame) -> DataFrame:
    """typed_output with `reason`: empty for the typed table; rows with one, or several, make the reject table."""
    wide = qa_first_confident(answers).groupBy("doc_id").pivot("field", list(FIELDS)).agg(F.first("answer"))
    reasons = [F.when(F.col(f).isNull(), f"{name}: not answered") for f, name in FIELDS.items()]
    for f, parse, what in (("Invoice_Date", X.parse_date, "a date"), ("Due_Date", X.parse_date, "a date"), ("Total", X.parse_amount_decimal, "an amount")):
        reasons.append(F.when(F.col(f).isNotNull() & parse(F.col(f)).isNull(), f"{FIELDS[f]}: not {what}"))
    return typed(wide, F.concat_ws(",", *reasons).alias("reason"))


@register("job_type_invoices", _TYPED.replace(" as mean_confidence", f" as mean_confidence, {_REASONS} as reason"))
def job_type_invoices(spark, sf):
    return typed_and_rejected(view(spark, sf, "v_qa"))


@register("confidence_map", f"select doc_id, f.field, case when a.answer is not null then 0.8 else 0.0 end as confidence from (select distinct doc_id from ({_FIRST})) d cross join (select unnest({list(FIELDS)}) as field) f left join ({_FIRST}) a using (doc_id, field)")
def confidence_map(spark, sf):
    wide = qa_first_confident(view(spark, sf, "v_qa")).groupBy("doc_id").pivot("field", list(FIELDS)).agg(F.first("answer"))
    pairs = [x for f in FIELDS for x in (F.lit(f), F.when(F.coalesce(f, F.lit("")) != "", 0.8).otherwise(0.0))]
    return wide.select("doc_id", F.explode(F.create_map(*pairs)).alias("field", "confidence"))


@register("payload_map", f"select doc_id, f.field, a.answer as value, case when a.answer is null then 'not_found' else 'layoutlm' end as method from (select distinct doc_id from v_qa) d cross join (select unnest({list(FIELDS)}) as field) f left join ({_FIRST}) a using (doc_id, field)")
def payload_map(spark, sf):
    """Every field of every document; what was not answered is not_found."""
    found = qa_first_confident(view(spark, sf, "v_qa"))
    docs = view(spark, sf, "v_qa").select("doc_id").distinct().withColumn("field", F.explode(F.array(*map(F.lit, FIELDS))))
    return docs.join(found.hint("merge"), ["doc_id", "field"], "left").select("doc_id", "field", F.col("answer").alias("value"), F.when(F.col("answer").isNull(), "not_found").otherwise("layoutlm").alias("method"))


@register("field_coverage", f"select field, count(*) as answered, round(count(*) / (select count(distinct doc_id) from v_qa), 6) as share from ({_FIRST}) group by field")
def field_coverage(spark, sf):
    answers = view(spark, sf, "v_qa")
    n = answers.agg(F.count_distinct("doc_id").alias("n"))  # one row
    return qa_first_confident(answers).groupBy("field").agg(F.count(F.lit(1)).alias("answered")).join(F.broadcast(n)).select("field", "answered", F.round(F.col("answered") / F.col("n"), 6).alias("share"))


@register("rename_fields", "select doc_id, case field when 'Invoice_Number' then 'numero_facture' when 'Invoice_Date' then 'date_facturation' when 'Due_Date' then 'echeance' when 'Issuer_Name' then 'nom_emetteur' when 'Client_Name' then 'nom_client' else 'total_ttc' end as field, answer from v_answers")
def rename_fields(spark, sf):
    names = {"Invoice_Number": "numero_facture", "Invoice_Date": "date_facturation", "Due_Date": "echeance", "Issuer_Name": "nom_emetteur", "Client_Name": "nom_client", "Total": "total_ttc"}
    mapping = F.create_map(*(F.lit(x) for kv in names.items() for x in kv))
    return view(spark, sf, "v_answers").select("doc_id", F.element_at(mapping, F.col("field")).alias("field"), "answer")


@register("union_records", "select doc_id, answer from v_qa where q_rank = 1 union all select doc_id, answer from v_qa where q_rank = 2")
def union_records(spark, sf):
    rows = view(spark, sf, "v_qa").select("doc_id", "answer", "q_rank")
    return rows.filter("q_rank = 1").drop("q_rank").unionByName(rows.filter("q_rank = 2").drop("q_rank"))


# JSON truth

_TRUTH = "select doc_id, case when doc_id % 10 = 0 then 'not json' when doc_id % 10 = 1 then '{\"total\": \"\"}' else concat('{\"total\": \"', cast(doc_id as string), '\", \"date\": \"\"}') end as ground_truth from v_docs"


def truth_rows(spark, sf) -> DataFrame:
    docs = view(spark, sf, "v_docs")
    text = F.when(F.col("doc_id") % 10 == 0, "not json").when(F.col("doc_id") % 10 == 1, '{"total": ""}').otherwise(F.concat(F.lit('{"total": "'), F.col("doc_id").cast("string"), F.lit('", "date": ""}')))
    return docs.select("doc_id", text.alias("ground_truth"))


@register("parse_truth_map", f"select doc_id, doc_id % 10 = 0 as malformed, case when doc_id % 10 = 0 then 0 when doc_id % 10 = 1 then 1 else 2 end as keys from ({_TRUTH})")
def parse_truth_map(spark, sf):
    rows = truth_rows(spark, sf).withColumn("m", truth_map())
    return rows.select("doc_id", F.col("m").isNull().alias("malformed"), F.coalesce(F.size("m"), F.lit(0)).alias("keys")).withColumn("keys", F.greatest("keys", F.lit(0)))


@register("truth_guardrail", f"select doc_id % 10 as part, bool_and(doc_id % 10 = 1) as all_blank from ({_TRUTH}) group by 1")
def truth_guardrail(spark, sf):
    """Whether all records of a part are blank; malformed JSON counts as not blank."""
    return truth_rows(spark, sf).groupBy((F.col("doc_id") % 10).alias("part")).agg(F.bool_and(is_blank()).alias("all_blank"))


@register("build_target_sequence", f"select doc_id, concat('<s_invoice>', ground_truth, '</s>') as target from ({_TRUTH})")
def build_target_sequence(spark, sf):
    return truth_rows(spark, sf).select("doc_id", F.concat(F.lit("<s_invoice>"), "ground_truth", F.lit("</s>")).alias("target"))


@register("parse_generated_json", f"select doc_id, case when doc_id % 10 = 0 then 'not json' end as raw_output, case when doc_id % 10 > 1 then cast(doc_id as varchar) when doc_id % 10 = 1 then '' end as total from ({_TRUTH})")
def parse_generated_json(spark, sf):
    """Tags and special tokens stripped, then JSON, else the text as raw_output."""
    rows = truth_rows(spark, sf).select("doc_id", F.trim(F.regexp_replace(F.concat(F.lit("<s_invoice>"), "ground_truth", F.lit("</s><pad>")), "<[^>]*>", "")).alias("t"))
    m = F.coalesce(truth_map("t"), F.create_map(F.lit("raw_output"), F.col("t")))
    return rows.select("doc_id", F.try_element_at(m, F.lit("raw_output")).alias("raw_output"), F.try_element_at(m, F.lit("total")).alias("total"))


@register("sink_json", f"select doc_id, '{{\"doc_id\":' || doc_id || ',\"field\":\"' || field || '\",\"answer\":\"' || answer || '\"}}' as json from ({_FIRST})")
def sink_json(spark, sf):
    """A JSON record for each answer, written and read back as lines."""
    path = new_path(spark, "fields")
    qa_first_confident(view(spark, sf, "v_qa")).select("doc_id", "field", "answer").write.json(path)
    return spark.read.text(path).select(F.get_json_object("value", "$.doc_id").cast("long").alias("doc_id"), F.col("value").alias("json"))


@register("text_source_choice", "select doc_id, case when content_type = 'application/pdf' and length(trim(native)) > 50 then 'native' else 'ocr' end as source from (select d.doc_id, content_type, repeat(filename, cast(d.doc_id % 6 as int)) as native from v_docs d)")
def text_source_choice(spark, sf):
    rows = view(spark, sf, "v_docs").withColumn("native", F.expr("repeat(filename, cast(doc_id % 6 as int))"))
    return rows.select("doc_id", F.when((F.col("content_type") == "application/pdf") & (F.length(F.trim("native")) > 50), "native").otherwise("ocr").alias("source"))


@register("engine_fallback", "select doc_id, max_by(model, k) as engine, string_agg(case when k < kk then model end, ',' order by k) as failed from (select *, min(k) filter (p >= 0.45) over (partition by doc_id) as kk from (select doc_id, model, max(p) as p, case model when 'svm' then 1 when 'lr' then 2 else 3 end as k from v_probs group by doc_id, model)) where k <= kk group by doc_id")
def engine_fallback(spark, sf):
    """The first engine, by rank, whose output is usable; those before it failed."""
    rank = F.when(F.col("model") == "svm", 1).when(F.col("model") == "lr", 2).otherwise(3)
    runs = view(spark, sf, "v_probs").groupBy("doc_id", "model").agg(F.max("p").alias("p")).withColumn("k", rank)
    tried = runs.withColumn("kk", F.min(F.when(F.col("p") >= 0.45, F.col("k"))).over(Window.partitionBy("doc_id"))).filter("k <= kk")
    done = tried.groupBy("doc_id").agg(F.min_by("model", -F.col("k")).alias("engine"), F.array_sort(F.collect_list(F.when(F.col("k") < F.col("kk"), F.struct("k", "model")))).alias("f"))
    return done.select("doc_id", "engine", F.nullif(F.array_join(F.transform("f", lambda r: r["model"]), ","), F.lit("")).alias("failed"))


QUERIES, ORACLES = register.queries, register.oracles

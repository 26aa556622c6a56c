"""Input views derived from the test tables. Each is one SELECT that Spark and DuckDB both accept."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")

VIEWS = {
    "v_docs": """
select o_orderkey as doc_id, o_custkey as owner_id,
 concat(case o_orderkey % 4 when 0 then 'invoice' when 1 then 'email' when 2 then 'resume' else 'paper' end, '-', cast(o_orderkey as string), '.pdf') as filename,
 case when o_orderkey % 5 = 0 then 'image/png' else 'application/pdf' end as content_type,
 cast(1024 + o_orderkey * 37 as bigint) as file_size,
 case when o_orderstatus = 'F' then 'done' when o_orderstatus = 'O' then 'pending' when o_orderkey % 2 = 0 then 'error' else 'processing' end as status,
 o_orderdate as created_at from orders""",
    "v_class": """
select o_orderkey as doc_id, case o_orderkey % 4 when 0 then 'invoice' when 1 then 'email' when 2 then 'resume' else 'scientific_publication' end as predicted_label,
 cast(50 + o_orderkey % 50 as double) / 100 as confidence, concat('v', cast(o_orderkey % 3 as string)) as model_version from orders where o_orderkey % 7 <> 0""",
    "v_extract": """
select o_orderkey as doc_id, concat('INV-', cast(100000 + o_orderkey as string)) as invoice_number, concat('Supplier ', cast(o_custkey % 97 as string)) as issuer_name,
 case o_orderkey % 3 when 0 then 'EUR' when 1 then 'USD' else '' end as currency, cast(o_totalprice as decimal(14,2)) as total_amount
from orders where o_orderkey % 4 = 0 and o_orderkey % 7 <> 0 and o_orderstatus = 'F'""",
    "v_users": "select c_custkey as owner_id, c_name as username from customer",
    "v_profiles": "select c_custkey as owner_id, concat('User ', cast(c_custkey as string)) as display_name, concat('/avatars/', cast(c_custkey as string), '.png') as avatar_url from customer where c_custkey % 3 <> 0",
    "v_uploads": """
select doc_id, owner_id, case when doc_id % 11 = 0 then null else filename end as filename,
 case when doc_id % 13 = 0 then 'application/zip' when doc_id % 17 = 0 then 'text/plain' else content_type end as content_type,
 case when doc_id % 19 = 0 then cast(30000000 as bigint) else file_size end as file_size, created_at from v_docs""",
    "v_invoice_lines": """
select o_orderkey as doc_id, 0 as region, 0 as line_no, concat('From: Supplier ', translate(cast(s as string),'0123456789','ABCDEFGHIJ')) as text
  from (select l_orderkey as o_orderkey, min(l_suppkey) as s from lineitem group by l_orderkey) a
union all select o_orderkey, 1, 1, concat('Invoice No: INV-', cast(100000 + o_orderkey as string)) from orders
union all select o_orderkey, 1, 2, concat('Date: ', lpad(cast(day(o_orderdate) as string),2,'0'),'/',lpad(cast(month(o_orderdate) as string),2,'0'),'/',cast(year(o_orderdate) as string)) from orders
union all select o_orderkey, 2, 3, 'Bill to' from orders
union all select o_orderkey, 2, 4, concat('Acme ', translate(cast(o_custkey as string),'0123456789','ABCDEFGHIJ')) from orders
union all select o_orderkey, 3, 5, 'Description' from orders
union all select l_orderkey, 3, cast(5 + row_number() over (partition by l_orderkey order by l_linenumber, l_partkey, l_suppkey, l_extendedprice) as int),
   concat('Part ', translate(cast(l_partkey as string),'0123456789','ABCDEFGHIJ'), ' ', cast(cast(l_extendedprice as decimal(14,2)) as string)) from lineitem
union all select o_orderkey, 4, 100, concat('Total: ', cast(cast(o_totalprice as decimal(14,2)) as string)) from orders""",
    "v_total_lines": """
select doc_id, region, line_no, text from v_invoice_lines
union all select o_orderkey, 4, 96, concat('Subtotal: ', cast(cast(o_totalprice as decimal(14,2)) as string)) from orders where o_orderkey % 2 = 0
union all select o_orderkey, 4, 97, concat('VAT ', cast(5 + o_orderkey % 16 as string), '%: ', cast(o_orderkey % 1000 as string), '.50') from orders where o_orderkey % 3 = 0
union all select o_orderkey, 4, 98, concat('Discount ', cast(1 + o_orderkey % 30 as string), '.5 %: ', cast(o_custkey % 100 as string), '.25') from orders where o_orderkey % 5 = 0""",
    "v_page_tokens": """
select doc_id, line_no * 4 + k as tok_no, text, x as xmin, x + 7.0 * length(text) as xmax, y as ymin, y + 12.0 as ymax from (
select doc_id, line_no, k, split_part(text, ' ', k) as text, cast(40 * (line_no % 3) + 110 * (k - 1) + 10 * (doc_id % 7) as double) as x, cast(18 * (line_no % 20) as double) as y
from v_invoice_lines cross join (select 1 as k union all select 2 union all select 3 union all select 4) n) t where text <> ''""",
    "v_contact_lines": """
select c_custkey as doc_id, 0 as region, 0 as line_no, 'Invoice summary' as text from customer
union all select c_custkey, 1, 1, concat('Company ', translate(cast(c_custkey as string),'0123456789','ABCDEFGHIJ')) from customer
union all select c_custkey, 1, 2, case when c_custkey % 2 = 0 then concat('info', cast(c_custkey as string), '@site.com') else 'no mail here' end from customer
union all select c_custkey, 1, 3, case when c_custkey % 3 = 0 then '+33 01 23 45 67' else 'call us soon' end from customer
union all select c_custkey, 1, 4, case when c_custkey % 5 = 0 then 'www.site.com' else 'open daily' end from customer
union all select c_custkey, 2, 5, 'Second Office' from customer
union all select c_custkey, 2, 6, case when c_custkey % 4 = 1 then '12 Main St' else 'closed' end from customer
union all select c_custkey, 2, 7, case when c_custkey % 7 = 1 then 'Some Road' else 'by car' end from customer""",
    "v_detections": """
select image_id, det_no, label, confidence, x1, y1, x1 + 20 + w * 4 as x2, y1 + 20 + w * 2 as y2 from (
select l_orderkey as image_id, row_number() over (partition by l_orderkey order by l_linenumber, l_partkey, l_suppkey, l_extendedprice) as det_no,
 case when l_linenumber % 4 = 0 then 'table' else 'paragraph' end as label, cast(l_partkey % 100 as double) / 100 as confidence,
 cast(l_partkey % 500 as double) as x1, cast(l_suppkey % 300 as double) as y1, l_quantity as w from lineitem) d""",
    "v_annotations": """
select concat('doc_', cast(image_id as string), case image_id % 3 when 0 then '.jpg' when 1 then '.png' else '.jpeg' end) as filename, 1000.0 as width, 800.0 as height,
 concat(label, '_', cast(image_id % 2 as string)) as class, x1 as xmin, y1 as ymin, x2 as xmax, y2 as ymax from v_detections""",
    "v_files": """
select o_orderkey as file_id, concat('doc', cast(div_5 as string),
 case o_orderkey % 5 when 0 then '_brightness_jpg.rf.' when 1 then '_affine_translation_png.rf.' when 2 then '_jpeg.rf.' when 3 then '.x' else '_gaussianblur.x' end,
 case when o_orderkey % 5 < 3 then md5(cast(o_orderkey as string)) else '' end, case o_orderkey % 2 when 0 then '.jpg' else '.png' end) as name from (select o_orderkey, cast(floor(o_orderkey / 5) as bigint) as div_5 from orders) o""",
    "v_qa": """
select doc_id, field, q_rank, answer, score from (
select doc_id, field, 1 as q_rank, case when doc_id % 6 = 0 then ' ' else answer end as answer, cast(doc_id % 20 as double) / 100 as score from v_answers
union all select doc_id, field, 2 as q_rank, concat(answer, case when doc_id % 4 = 0 then ' EUR' else '' end) as answer, cast((doc_id * 7) % 20 as double) / 100 as score from v_answers) q""",
    "v_answers": """
select o_orderkey as doc_id, 'Invoice_Number' as field, concat('INV-', cast(100000 + o_orderkey as string)) as answer from orders
union all select o_orderkey, 'Invoice_Date', concat(lpad(cast(day(o_orderdate) as string),2,'0'),'/',lpad(cast(month(o_orderdate) as string),2,'0'),'/',cast(year(o_orderdate) as string)) from orders
union all select o_orderkey, 'Due_Date', case when o_orderkey % 3 = 0 then '31/02/2024' else concat(cast(year(o_orderdate) as string),'-',lpad(cast(month(o_orderdate) as string),2,'0'),'-',lpad(cast(day(o_orderdate) as string),2,'0')) end from orders
union all select o_orderkey, 'Issuer_Name', concat('Supplier ', cast(o_custkey % 97 as string)) from orders
union all select o_orderkey, 'Client_Name', concat('Acme ', cast(o_custkey as string)) from orders
union all select o_orderkey, 'Total', concat(case o_orderkey % 3 when 0 then '$' when 1 then '€ ' else '' end, cast(cast(o_totalprice as decimal(14,2)) as string)) from orders""",
    "v_truth_pred": """
select t.doc_id, t.field, case when t.doc_id % 9 = 0 then '' else t.answer end as gt,
 case t.doc_id % 5 when 0 then '' when 1 then concat('$', upper(t.answer)) when 2 then substring(t.answer, 1, 4) when 3 then 'other' else concat(t.answer, ' ') end as pred from v_answers t""",
    "v_class_pred": """
select doc_id, lang as actual, case when doc_id % 5 = 0 then 'en' when doc_id % 7 = 0 then 'fr' else lang end as predicted from documents""",
    "v_probs": """
select d.doc_id, m.model, l.label, (case when d.lang = l.label then 0.4 else 0.0 end) + cast((d.doc_id * m.k + l.j * 13) % 20 as double) / 100 as p
from documents d cross join (select 'svm' as model, 3 as k union all select 'lr', 5 union all select 'rf', 7) m cross join (select 'de' as label, 1 as j union all select 'en', 2 union all select 'es', 3 union all select 'fr', 4) l""",
    "v_status_events": """
select event_id, user_id as doc_id, ts, case event_type when 'view' then 'pending' when 'click' then 'processing' when 'purchase' then 'done' else 'error' end as status
from events where event_type <> 'signup'""",
    "v_phrases": """
select c_custkey as id, case c_custkey % 12 when 0 then concat(cast(c_custkey as string), ' Main Street') when 1 then 'SW1A 2AA' when 2 then lpad(cast(c_custkey as string), 5, '0')
 when 3 then concat('+33 1 23 45 ', lpad(cast(c_custkey % 100 as string), 2, '0')) when 4 then 'INVOICE SUMMARY PAGE' when 5 then concat('Invoice # ABC-', cast(1000 + c_custkey as string))
 when 6 then concat('no. ', cast(10000 + c_custkey as string), ' / x') when 7 then concat('VAT 20%: ', cast(c_custkey as string), '.50 EUR') when 8 then 'designation date debut quantite tva'
 when 9 then 'Total TTC - 1 234,56' when 10 then concat('info', cast(c_custkey as string), '@site.con now') else concat('Ref: ', cast(c_custkey as string), ' le 05/03/1998') end as text from customer""",
    "v_metrics": """
select model, features, cast(acc as double) as accuracy from (select 'svm' as model, 'text' as features, 0.825 as acc union all select 'lr', 'text', 0.80 union all select 'rf', 'hybrid', 0.938 union all select 'svm', 'hybrid', 0.938 union all select 'nb', 'image', 0.638) m""",
}


def needs(sql: str) -> list[str]:
    """Views that a statement reads, each after those it reads itself."""
    found: list[str] = []
    for name in re.findall(r"\bv_\w+", sql):
        if name in VIEWS and name not in found:
            found += [x for x in needs(VIEWS[name]) if x not in found] + [name]
    return list(dict.fromkeys(found))


def oracle(sql: str) -> str:
    """A DuckDB statement with the views it names in front."""
    parts = [f"{n} as ({VIEWS[n].strip()})" for n in needs(sql)]
    return f"with {', '.join(parts)} {sql.strip()}" if parts else sql.strip()


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A view, or a table, as a DataFrame."""
    if name in TABLES:
        return spark.read.parquet(f"{sf_dir}/{name}.parquet")
    sql = VIEWS[name]
    inputs = {n: view(spark, sf_dir, n) for n in (*TABLES, *VIEWS) if re.search(rf"\b{n}\b", sql) and n != name}
    for n in inputs:
        sql = re.sub(rf"(from|join)(\s+){n}\b", rf"\1\2{{{n}}}", sql)
    return spark.sql(sql, **{n: d for n, d in inputs.items() if f"{{{n}}}" in sql})

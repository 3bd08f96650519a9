"""Queries of the training-data operators and their SQL, where SQL can say it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from graphloom.llm import credentials, fusion, handwritten, markup, mixing, packing, parsing, spans
from graphloom.plans.integrity import repaired
from graphloom.session import table


def _files(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "source_files").select("graphId", "path", "content")


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return markup.markup_found(markup.clean_articles(table(spark, d, "nodes")))


def p2_clean(spark: SparkSession, d: str) -> DataFrame:
    return markup.clean_articles(table(spark, d, "nodes"))


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    # The result is defined by the latest delivery, so time counts for more than votes.
    return fusion.fuse(table(spark, d, "nodes"), fusion.STRICTLY_LATEST).where("n_rows >= 2 and n_deletes = 0").select("graphId", "id", "summary_row", "tags_row")


def p3_survivors(spark: SparkSession, d: str) -> DataFrame:
    return fusion.survivors(table(spark, d, "nodes"))


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return handwritten.classify_files(_files(spark, d)).where("kind is not null").select("graphId", "path")


def p4_kinds(spark: SparkSession, d: str) -> DataFrame:
    return handwritten.classify_files(_files(spark, d))


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return parsing.parse_failures(_files(spark, d)).select("graphId", "path")


def p5_rates(spark: SparkSession, d: str) -> DataFrame:
    return parsing.parse_rates(_files(spark, d), parsing.parse_failures(_files(spark, d)))


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    return credentials.find_credentials(_files(spark, d)).select("graphId", "path", "line_no")


def p7_redacted(spark: SparkSession, d: str) -> DataFrame:
    return credentials.redact_credentials(_files(spark, d))


def _packed(spark: SparkSession, d: str, only_best_fit: bool = False) -> DataFrame:
    return packing.pack_documents(table(spark, d, "documents").select("doc_id", "text"), table(spark, d, "pack_specs"), only_best_fit)


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    return packing.split_documents(_packed(spark, d))


def p8_packed(spark: SparkSession, d: str) -> DataFrame:
    return _packed(spark, d)


def p8_fill(spark: SparkSession, d: str) -> DataFrame:
    return packing.fill_report(_packed(spark, d), _packed(spark, d, True))


def p9_mix(spark: SparkSession, d: str) -> DataFrame:
    return mixing.mix(table(spark, d, "documents").select("doc_id", "source", "text"), table(spark, d, "mix_targets"))


def p9_shares(spark: SparkSession, d: str) -> DataFrame:
    return mixing.share_report(p9_mix(spark, d), table(spark, d, "mix_targets"))


def p10_found(spark: SparkSession, d: str) -> DataFrame:
    return spans.shared_pairs(table(spark, d, "documents"))


def p10_shares(spark: SparkSession, d: str) -> DataFrame:
    return spans.shared_shares(table(spark, d, "documents"))


def p10_passages(spark: SparkSession, d: str) -> DataFrame:
    return spans.repeated_passages(table(spark, d, "documents"))


def p10_classes(spark: SparkSession, d: str) -> DataFrame:
    return spans.span_classes(table(spark, d, "documents"))


def p10_clean(spark: SparkSession, d: str) -> DataFrame:
    return spans.without_repeats(table(spark, d, "documents"))


QUERIES = {
    f.__name__: f
    for f in (
        p2_found, p2_clean, p3_found, p3_survivors, p4_found, p4_kinds, p5_found, p5_rates, p7_found, p7_redacted, p8_found, p8_packed, p8_fill,
        p9_mix, p9_shares, p10_found, p10_shares, p10_passages, p10_classes, p10_clean,
    )
}

_PLACEHOLDERS = ", ".join("'" + x.replace("'", "''") + "'" for x in fusion.PLACEHOLDER_TEXTS)
_TAGS = ", ".join(f"'{x}'" for x in fusion.PLACEHOLDER_TAGS)
_EDGE = r"[\s.\-–—_*?!:<>\[\](){}]+"


def _core(x: str) -> str:
    return f"regexp_replace(lower(trim({x})), '^{_EDGE}|{_EDGE}$', '', 'g')"


_SUMMARY_OK = (
    f"coalesce(trim(summary) <> '' and {_core('summary')} not in ({_PLACEHOLDERS}) and {_core('summary')} is distinct from {_core('name')} and {_core('summary')} is distinct from {_core('filePath')}"
    f" and {_core('summary')} is distinct from {_core(chr(115) + 'plit_part(filePath, ' + repr('/') + ', -1)')} and not regexp_matches(trim(summary), '(…|\\.\\.+|[,;:(\\[–-])$'), false)"
)
_TAGS_OK = f"len(list_filter(coalesce(tags, []), lambda t: t is not null and {_core('t')} not in ({_TAGS}))) > 0"
# Every stretch of 200 characters of every text, by brute force.
_W10 = """with dd as (select doc_id, text, min(doc_id) over (partition by text) as rep, count(*) over (partition by text) as k from documents where length(text) >= 200),
 w as (select doc_id, rep, i, hash(substr(text, i, 200)) as h from (select doc_id, rep, text, unnest(range(1, length(text) - 198)) as i from dd)),"""
_C10 = " s as (select h from w where doc_id = rep group by h having count(distinct rep) > 1), k as (select w.rep, i, h from w semi join s using (h) where doc_id = rep), d as (select distinct rep, h from k)"
ORACLE = {
    "p10_found": _W10 + " s as (select h from w group by h having count(distinct doc_id) > 1), d as (select distinct doc_id, h from w semi join s using (h)) select distinct a.doc_id as doc_a, b.doc_id as doc_b from d a join d b on a.h = b.h and a.doc_id < b.doc_id",
    "p10_shares": _W10 + """ s as (select h from w group by h having count(distinct doc_id) > 1), k as (select doc_id, i, lead(i) over (partition by doc_id order by i) as nxt from w semi join s using (h)), c as (select doc_id, sum(least(200, coalesce(nxt - i, 200))) as n from k group by 1)
      select o.doc_id, coalesce(length(o.text), 0)::int as n_chars, coalesce(c.n, 0)::bigint as shared_chars, round(case when length(o.text) > 0 then coalesce(c.n, 0) / length(o.text) else 0 end, 6) as share, coalesce(dd.k - 1, 0) as n_twins from documents o left join c using (doc_id) left join dd on dd.doc_id = o.doc_id""",
    "p10_classes": _W10 + _C10 + ", l as (select distinct a.rep, b.rep as other from d a join d b on a.h = b.h and a.rep <> b.rep), n as (select rep, count(*) as n_links from l group by 1) select dd.doc_id, dd.rep, dd.k as n_copies, coalesce(n_links, 0) as n_links from dd left join n using (rep)",
    "p10_passages": _W10 + _C10 + ", g as (select rep, i, sum(case when i <= coalesce(lag_i, -1000) + 200 then 0 else 1 end) over (partition by rep order by i) as isle from (select rep, i, lag(i) over (partition by rep order by i) as lag_i from (select distinct rep, i from k))) select rep, (min(i) - 1)::int as start, (max(i) + 199)::int as stop from g group by rep, isle",
    "p3_found": f"""with n as (select *, {repaired("id", "type", "filePath", "name")} as rid from nodes where trim(coalesce(id, '')) <> '')
      select graphId, rid as id, arg_max(node_row, arrivedAt) filter ({_SUMMARY_OK}) as summary_row, arg_max(node_row, arrivedAt) filter ({_TAGS_OK}) as tags_row
      from n group by graphId, rid having count(*) >= 2 and count(*) filter (op = 'delete') = 0""",
    "p8_found": """select s.spec_id, d.doc_id from pack_specs s, documents d where d.text is not null and octet_length(encode(d.text)) + 1 > s.capacity""",
}

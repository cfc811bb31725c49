"""The registered queries of this subpackage, one per operator, each over its whole tables; SQL where DuckDB can say the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tessera.llm import decontaminate, html, jaccard, language, licenses, neighbours, pieces, quality, urls, warc
from tessera.llm.common import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


@query()
def op1_language(spark: SparkSession, root: str) -> DataFrame:
    return language.identify(table(spark, root, "documents"))


@query()
def op2_pieces(spark: SparkSession, root: str) -> DataFrame:
    return pieces.tokenise(table(spark, root, "documents"))


@query()
def op7_quality(spark: SparkSession, root: str) -> DataFrame:
    return quality.classify(table(spark, root, "documents"), table(spark, root, "labels"))


_B32 = "".join(
    f" || substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', ((('0x' || substr(sha1(p), {i + 1}, 5))::BIGINT >> {s}) & 31)::INT + 1, 1)" for i in range(0, 40, 5) for s in (15, 10, 5, 0)
)[4:]


@query(
    f"""WITH x AS (SELECT page_id, coalesce(html, '') AS p FROM pages), y AS (SELECT page_id, strlen(p)::BIGINT AS payload_bytes, {_B32} AS payload_digest FROM x),
    z AS (SELECT *, min(page_id) OVER (PARTITION BY payload_digest, payload_bytes) AS first_id FROM y)
    SELECT page_id, payload_bytes, payload_digest, CASE WHEN page_id = first_id THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> first_id THEN first_id END AS refers_to FROM z"""
)
def op8_warc(spark: SparkSession, root: str) -> DataFrame:
    return warc.captures(table(spark, root, "pages"))


@query()
def op5_html(spark: SparkSession, root: str) -> DataFrame:
    return html.extract(table(spark, root, "pages"))


@query()
def op6_urls(spark: SparkSession, root: str) -> DataFrame:
    return urls.judge(table(spark, root, "pages"))


@query()
def op9_decontaminate(spark: SparkSession, root: str) -> DataFrame:
    return decontaminate.leaks(table(spark, root, "documents"), table(spark, root, "benchmark"))


_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


@query(
    f"""WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
    s AS (SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
        ELSE list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))) END AS s FROM d),
    n AS (SELECT doc_id, len(s)::BIGINT AS n FROM s), u AS (SELECT doc_id, hash(unnest(s)) AS h FROM s),
    i AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS i FROM u a JOIN u b USING (h) WHERE a.doc_id < b.doc_id GROUP BY 1, 2),
    l AS (SELECT a, b FROM i JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * i >= 75 * (x.n + y.n - i)),
    e AS (SELECT a, b FROM l UNION SELECT b, a FROM l),
    r(doc_id, c) AS (SELECT doc_id, doc_id FROM n UNION SELECT e.b, r.c FROM r JOIN e ON e.a = r.doc_id)
    SELECT n.doc_id, any_value(n) AS n_shingles, min(c) AS component_id FROM n JOIN r USING (doc_id) GROUP BY n.doc_id"""
)
def op10_jaccard(spark: SparkSession, root: str) -> DataFrame:
    return jaccard.link(table(spark, root, "documents"))


@query()
def op4_neighbours(spark: SparkSession, root: str) -> DataFrame:
    return neighbours.search_own(table(spark, root, "embeddings"))


_TEMPLATE_ROWS = ", ".join("({}, '{}', '{}')".format(i, name, text.replace("'", "''")) for i, (name, text) in enumerate(licenses.TEMPLATES))
_SHINGLED = f"regexp_extract_all(translate(text, '{_UPPER}', '{_LOWER}'), '[a-z0-9]+')"


@query(
    f"""WITH t AS (SELECT template, license, unnest(list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')))) AS s
        FROM (SELECT template, license, {_SHINGLED} AS w FROM (VALUES {_TEMPLATE_ROWS}) v(template, license, text))),
    n AS (SELECT template, count(*) AS n FROM t GROUP BY 1),
    d AS (SELECT DISTINCT doc_id, unnest(list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')))) AS s FROM (SELECT doc_id, {_SHINGLED} AS w FROM documents WHERE text IS NOT NULL)),
    f AS (SELECT doc_id, template, license, count(*) AS n_found FROM d JOIN t USING (s) GROUP BY ALL)
    SELECT doc_id, template, license, n_found::INT AS n_found, n_found * 1.0::DOUBLE / n AS containment FROM f JOIN n USING (template) WHERE n_found >= n * 0.75"""
)
def op3_licenses(spark: SparkSession, root: str) -> DataFrame:
    return licenses.scan(table(spark, root, "documents"))

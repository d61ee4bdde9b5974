"""The queries of this package and, where SQL can state them, their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tallyloom.llm import answer_defects, leakage, near_duplicates, packing, residue, site_lines, splitting, survivors
from tallyloom.session import read_table


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return near_duplicates.similar_pairs(read_table(spark, d, "chunks"))


def p1_groups(spark: SparkSession, d: str) -> DataFrame:
    return near_duplicates.duplicate_groups(read_table(spark, d, "chunks")).select("id", "group_id", "links")


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return answer_defects.found(read_table(spark, d, "eval_results"))


def p2_labels(spark: SparkSession, d: str) -> DataFrame:
    return answer_defects.labelled(read_table(spark, d, "eval_results"))


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return site_lines.found_lines(read_table(spark, d, "chunks"))


def p3_clean(spark: SparkSession, d: str) -> DataFrame:
    return site_lines.without_lines(read_table(spark, d, "chunks"))


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return splitting.oversized(read_table(spark, d, "chunks"), read_table(spark, d, "size_limits"))


def p4_pieces(spark: SparkSession, d: str) -> DataFrame:
    return splitting.pieces(read_table(spark, d, "chunks"), read_table(spark, d, "size_limits"))


def p4_rejoined(spark: SparkSession, d: str) -> DataFrame:
    """The pieces of every cut chunk, put together again."""
    return splitting.rejoined(read_table(spark, d, "chunks"), read_table(spark, d, "size_limits"))


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return survivors.latest_survivors(read_table(spark, d, "financial_facts"), read_table(spark, d, "filings"))


def p5_truth(spark: SparkSession, d: str) -> DataFrame:
    return survivors.truth_discovery(read_table(spark, d, "financial_facts"), read_table(spark, d, "filings"))[0].drop("value")


def p6_containers(spark: SparkSession, d: str) -> DataFrame:
    return packing.pack(read_table(spark, d, "documents"), read_table(spark, d, "size_limits"))


def p6_use(spark: SparkSession, d: str) -> DataFrame:
    """One row on the packing of all documents."""
    limits = read_table(spark, d, "size_limits")
    capacity = limits.where("item_kind = 'container'").agg({"max_size": "max"}).first()[0]
    return packing.packed(packing.pack(read_table(spark, d, "documents"), limits), capacity)


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    return leakage.leaks(read_table(spark, d, "documents"), read_table(spark, d, "eval_items"))


def p7_matches(spark: SparkSession, d: str) -> DataFrame:
    return leakage.matches(read_table(spark, d, "documents"), read_table(spark, d, "eval_items"))


def p7_clean(spark: SparkSession, d: str) -> DataFrame:
    return leakage.without_leaks(read_table(spark, d, "documents"), read_table(spark, d, "eval_items")).select("doc_id")


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    return residue.kinds(read_table(spark, d, "documents"))


def p8_clean(spark: SparkSession, d: str) -> DataFrame:
    return residue.without_residue(read_table(spark, d, "documents")).select("doc_id")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "p1_found": p1_found,
        "p1_groups": p1_groups,
        "p2_found": p2_found,
        "p2_labels": p2_labels,
        "p3_found": p3_found,
        "p3_clean": p3_clean,
        "p4_found": p4_found,
        "p4_pieces": p4_pieces,
        "p4_rejoined": p4_rejoined,
        "p5_found": p5_found,
        "p5_truth": p5_truth,
        "p6_containers": p6_containers,
        "p6_use": p6_use,
        "p7_found": p7_found,
        "p7_matches": p7_matches,
        "p7_clean": p7_clean,
        "p8_found": p8_found,
        "p8_clean": p8_clean,
    }


_WORDS = r"regexp_extract_all(lower({0}), '[\p{{L}}\p{{N}}]+')"
_GRAM = "array_to_string(w[i : i + {0}], ' ')"
_WHITE = r"\t-\r\x{1C}-\x{20}\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}"
_KIND = r"coalesce(nullif(trim(regexp_replace(lower(trim(file_type)), '^\.', '')), ''), 'other')"
_KEY = r"regexp_replace(regexp_replace(lower(line), '[^\p{L}\p{Nd}]+', '', 'g'), '\p{Nd}+', '0', 'g')"
_FILLED = {
    "value": "value IS NOT NULL AND NOT isnan(value)",
    "unit": "unit IS NOT NULL",
    "period_start": "period_start IS NOT NULL",
    "period_end": "period_end IS NOT NULL",
    "duration_days": "duration_days IS NOT NULL",
    "source_page": "source_page IS NOT NULL",
}


def _text_filled(c: str) -> str:
    nothing = ", ".join(f"'{w}'" for w in survivors.NOTHING)
    return rf"{c} IS NOT NULL AND regexp_matches({c}, '[\p{{L}}\p{{Nd}}]') AND lower(trim({c})) NOT IN ({nothing})"


def _p5_groups() -> str:
    """CTEs up to q: the facts of groups, with their group_id."""
    base = r"SELECT DISTINCT f.*, g.company_id, g.filed_date, regexp_replace(lower(canonical_field), '[^\p{L}\p{Nd}]+', '', 'g') AS fld, coalesce(duration_days, date_diff('day', period_start, period_end)) IS NULL AS pt, coalesce(duration_days, date_diff('day', period_start, period_end), 0) AS len, date_diff('day', DATE '1970-01-01', period_end) AS d FROM financial_facts f JOIN filings g USING (filing_id) WHERE period_end IS NOT NULL AND company_id IS NOT NULL"
    # chains of admissible pairs, by the transitive closure of the pairs of (end, length)
    return f"""b AS ({base}), c AS (SELECT company_id, fld, pt, d, len, min(fact_id) AS id FROM b WHERE fld <> '' GROUP BY ALL),
    e AS (SELECT x.id AS u, y.id AS v FROM c x JOIN c y ON x.company_id = y.company_id AND x.fld = y.fld AND x.pt = y.pt AND abs(x.d - y.d) <= {survivors.DAYS_APART} AND abs(x.len - y.len) <= {survivors.LENGTH_APART}),
    r(id, root) AS (SELECT id, id FROM c UNION SELECT e.v, r.root FROM r JOIN e ON e.u = r.id), k AS (SELECT id, min(root) AS root FROM r GROUP BY id),
    q AS (SELECT b.*, root, min(fact_id) OVER (PARTITION BY root) AS group_id FROM b JOIN c USING (company_id, fld, pt, d, len) JOIN k ON k.id = c.id QUALIFY min(fact_id) OVER (PARTITION BY root) <> max(fact_id) OVER (PARTITION BY root))"""


_P5_FILLED = _FILLED | {c: _text_filled(c) for c in ("unit", "source_page")}


def _p5_sql() -> str:
    each = " UNION ALL ".join(f"SELECT group_id, '{c}' AS field_name, fact_id FROM q WHERE {t} QUALIFY row_number() OVER (PARTITION BY group_id ORDER BY filed_date DESC NULLS LAST, filing_id DESC, fact_id DESC) = 1" for c, t in _P5_FILLED.items())
    return f"WITH RECURSIVE {_p5_groups()} {each}"


def _p5_truth_sql() -> str:
    claim = {c: r"lower(trim(regexp_replace({0}::VARCHAR, '\s+', ' ', 'g')))".format(c) for c in _P5_FILLED} | {"value": "CASE WHEN value = 0 THEN '0' ELSE round(value / pow(10.0, floor(log10(abs(value))) - 5))::BIGINT || 'e' || (floor(log10(abs(value)))::BIGINT - 5) END"}
    claims = " UNION ALL ".join(f"SELECT group_id, filing_id, fact_id, filed_date, '{c}' AS field_name, {claim[c]} AS claim FROM q WHERE {t}" for c, t in _P5_FILLED.items())
    return f"""WITH RECURSIVE {_p5_groups()}, cl AS MATERIALIZED ({claims}), v AS MATERIALIZED (SELECT DISTINCT group_id, field_name, claim, filing_id FROM cl),
    t(k, filing_id, rel, step) AS (SELECT DISTINCT 0, filing_id, 0.5::DOUBLE, 1.0::DOUBLE FROM v UNION ALL
      SELECT k + 1, filing_id, new, abs(new - rel) FROM (SELECT k, filing_id, rel, last_step, round((sum(w / total) + 0.5) / (count(*) + 1), 9) AS new FROM (
        SELECT v.*, k, rel, max(step) OVER () AS last_step, sum(rel) OVER (PARTITION BY group_id, field_name, claim) AS w, sum(rel) OVER (PARTITION BY group_id, field_name) AS total FROM v JOIN t USING (filing_id)) GROUP BY ALL) WHERE k % 4 <> 0 OR last_step > 1e-3),
    z AS (SELECT filing_id, rel FROM t WHERE k = (SELECT max(k) FROM t)), w AS (SELECT group_id, field_name, claim, sum(rel) AS w, count(*) AS claims FROM v JOIN z USING (filing_id) GROUP BY ALL),
    l AS (SELECT group_id, field_name, claim, max((coalesce(filed_date, DATE '0001-01-01'), filing_id, fact_id)) AS last FROM cl GROUP BY ALL)
    SELECT group_id, field_name, claim, round(w / total, 6) AS support, claims, last[3] AS fact_id FROM (SELECT *, sum(w) OVER (PARTITION BY group_id, field_name) AS total FROM w JOIN l USING (group_id, field_name, claim))
    QUALIFY row_number() OVER (PARTITION BY group_id, field_name ORDER BY round(w, 9) DESC, last DESC) = 1"""


_SQL = {
    "p1_found": f"""WITH c AS (SELECT DISTINCT id, {_WORDS.format('content')} AS w FROM chunks), g AS (SELECT DISTINCT id, {_GRAM.format(2)} AS gram FROM (SELECT id, w, unnest(range(1, len(w) - 1)) AS i FROM c)), n AS (SELECT id, count(*) AS n FROM g GROUP BY id),
    p AS (SELECT a.id AS id_a, b.id AS id_b, count(*) AS k FROM g a JOIN g b ON a.gram = b.gram AND a.id < b.id GROUP BY 1, 2) SELECT id_a, id_b FROM p JOIN n x ON x.id = id_a JOIN n y ON y.id = id_b WHERE 2 * k >= x.n + y.n - k""",
    "p1_groups": f"""WITH RECURSIVE t AS (SELECT DISTINCT id, content FROM chunks WHERE id IS NOT NULL), x AS (SELECT id, CASE WHEN content IS NULL THEN [] ELSE {_WORDS.format("coalesce(content, '')")} END AS w FROM t),
    c AS (SELECT w, min(id) AS class FROM x WHERE len(w) >= 3 GROUP BY w), m AS (SELECT x.id, coalesce(c.class, x.id) AS class FROM x LEFT JOIN c USING (w)), g AS (SELECT DISTINCT class, {_GRAM.format(2)} AS gram FROM (SELECT class, w, unnest(range(1, len(w) - 1)) AS i FROM c)), n AS (SELECT class, count(*) AS n FROM g GROUP BY 1),
    p AS (SELECT a.class AS a, b.class AS b, count(*) AS k FROM g a JOIN g b ON a.gram = b.gram AND a.class < b.class GROUP BY 1, 2), e AS (SELECT a, b FROM p JOIN n x ON x.class = a JOIN n y ON y.class = b WHERE 2 * k >= x.n + y.n - k), u AS (SELECT a, b FROM e UNION ALL SELECT b, a FROM e),
    r(class, root) AS (SELECT class, class FROM c UNION SELECT u.b, r.root FROM r JOIN u ON u.a = r.class), k AS (SELECT class, min(root) AS root FROM r GROUP BY 1), l AS (SELECT a AS class, count(*) AS links FROM u GROUP BY 1)
    SELECT id, min(id) OVER (PARTITION BY coalesce(root, class)) AS group_id, coalesce(links, 0) AS links FROM m LEFT JOIN k USING (class) LEFT JOIN l USING (class)""",
    "p3_found": f"""WITH c AS (SELECT DISTINCT id, paper_id, upper(trim(ticker)) AS t, content, is_table FROM chunks WHERE trim(ticker) <> ''), p AS (SELECT t, count(DISTINCT paper_id) AS papers FROM c GROUP BY t),
    l AS (SELECT id, paper_id, t, unnest(string_split(content, chr(10))) AS line, generate_subscripts(string_split(content, chr(10)), 1) AS line_no FROM c WHERE NOT coalesce(is_table, false)), k AS (SELECT *, {_KEY} AS key FROM l),
    g AS (SELECT t, key, count(DISTINCT paper_id) AS n FROM k WHERE key <> '' GROUP BY 1, 2) SELECT DISTINCT id, line_no::INT AS line_no FROM k JOIN g USING (t, key) JOIN p USING (t) WHERE n >= 5 AND 5 * n >= papers""",
    "p3_clean": f"""WITH c AS (SELECT DISTINCT id, paper_id, nullif(upper(trim(ticker)), '') AS t, content, coalesce(is_table, false) AS tab FROM chunks), p AS (SELECT t, count(DISTINCT paper_id) AS papers FROM c WHERE t IS NOT NULL GROUP BY t),
    l AS (SELECT id, paper_id, t, unnest(string_split(content, chr(10))) AS line, generate_subscripts(string_split(content, chr(10)), 1) AS line_no FROM c WHERE NOT tab AND t IS NOT NULL), k AS (SELECT *, {_KEY} AS key FROM l),
    g AS (SELECT t, key FROM (SELECT t, key, count(DISTINCT paper_id) AS n FROM k WHERE key <> '' GROUP BY 1, 2) JOIN p USING (t) WHERE n >= 5 AND 5 * n >= papers),
    z AS (SELECT k.id, string_agg(line, chr(10) ORDER BY line_no) FILTER (g.key IS NULL) AS rest, count(g.key)::INT AS removed FROM k LEFT JOIN g USING (t, key) GROUP BY 1)
    SELECT c.id, CASE WHEN removed > 0 THEN coalesce(rest, '') ELSE content END AS content, coalesce(removed, 0)::INT AS removed FROM (SELECT DISTINCT id, content FROM c) c LEFT JOIN z USING (id)""",
    "p4_rejoined": f"""WITH c AS (SELECT DISTINCT id, {_KIND} AS kind, regexp_extract_all(content, '[^{_WHITE}]+') AS w FROM chunks WHERE content IS NOT NULL), s AS (SELECT * FROM size_limits WHERE size_unit = 'words'),
    m AS (SELECT id, w, coalesce(o.max_size, z.max_size) AS most, CASE WHEN o.item_kind IS NULL THEN z.overlap_size ELSE o.overlap_size END AS over FROM c LEFT JOIN s o ON o.item_kind = kind, (SELECT * FROM s WHERE item_kind = 'other') z)
    SELECT id, len(w)::BIGINT AS n_words, md5(array_to_string(w, ' ')) AS words_md5, true AS fits, over::INT AS least_shared, over::INT AS most_shared FROM m WHERE len(w) > most""",
    "p4_found": f"""WITH c AS (SELECT DISTINCT id, {_KIND} AS kind, len(regexp_extract_all(content, '[^{_WHITE}]+')) AS n FROM chunks WHERE content IS NOT NULL), s AS (SELECT * FROM size_limits WHERE size_unit = 'words')
    SELECT DISTINCT id FROM c WHERE n > coalesce((SELECT max_size FROM s WHERE item_kind = kind), (SELECT max_size FROM s WHERE item_kind = 'other'))""",
    "p5_found": _p5_sql(),
    "p5_truth": _p5_truth_sql(),
    "p6_use": "SELECT 0::BIGINT AS over, 0::BIGINT AS bad_slots, true AS full, count(DISTINCT doc_id) AS documents, 0::BIGINT AS repeated FROM documents",
    "p7_matches": f"""WITH g AS (SELECT DISTINCT item_id, i, {_GRAM.format(11)} AS gram FROM (SELECT item_id, w, unnest(range(1, len(w) - 10)) AS i FROM (SELECT item_id, {_WORDS.format('item_text')} AS w FROM eval_items))),
    d AS (SELECT DISTINCT doc_id, i, {_GRAM.format(11)} AS gram FROM (SELECT doc_id, w, unnest(range(1, len(w) - 10)) AS i FROM (SELECT doc_id, {_WORDS.format('text')} AS w FROM documents WHERE text IS NOT NULL))),
    h AS (SELECT doc_id, item_id, d.i AS di, g.i AS gi FROM d JOIN g USING (gram)), r AS (SELECT *, di - row_number() OVER (PARTITION BY doc_id, item_id, di - gi ORDER BY di) AS run FROM h)
    SELECT doc_id, item_id, (min(di) - 1)::INT AS doc_word, (min(gi) - 1)::INT AS item_word, (count(*) + 11)::INT AS n_words FROM r GROUP BY doc_id, item_id, di - gi, run""",
    "p7_clean": f"""WITH g AS (SELECT DISTINCT {_GRAM.format(11)} AS gram FROM (SELECT w, unnest(range(1, len(w) - 10)) AS i FROM (SELECT {_WORDS.format('item_text')} AS w FROM eval_items))),
    d AS (SELECT DISTINCT doc_id, {_GRAM.format(11)} AS gram FROM (SELECT doc_id, w, unnest(range(1, len(w) - 10)) AS i FROM (SELECT doc_id, {_WORDS.format('text')} AS w FROM documents WHERE text IS NOT NULL))) SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM d JOIN g USING (gram))""",
    "p7_found": f"""WITH g AS (SELECT DISTINCT item_id, {_GRAM.format(11)} AS gram FROM (SELECT item_id, w, unnest(range(1, len(w) - 10)) AS i FROM (SELECT item_id, {_WORDS.format('item_text')} AS w FROM eval_items))),
    d AS (SELECT DISTINCT doc_id, {_GRAM.format(11)} AS gram FROM (SELECT doc_id, w, unnest(range(1, len(w) - 10)) AS i FROM (SELECT doc_id, {_WORDS.format('text')} AS w FROM documents WHERE text IS NOT NULL))) SELECT DISTINCT doc_id, item_id FROM d JOIN g USING (gram)""",
}


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)

"""SQL for DuckDB with the results of those operators that SQL can express."""

from __future__ import annotations

WORDS = r"regexp_extract_all(coalesce({0}, ''), '[^\x20\x09-\x0D]+')"
LOWERED = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

MIX = rf"""WITH docs AS (SELECT doc_id, source, CAST(len({WORDS.format("text")}) AS BIGINT) AS size,
  -ln((CAST('0x' || substr(md5('17:' || coalesce(CAST(doc_id AS VARCHAR), '')), 1, 12) AS BIGINT)::DOUBLE + 0.5) / 281474976710656.0::DOUBLE)
  / CASE WHEN text IS NULL THEN 1.0::DOUBLE ELSE length(regexp_replace(text, '[^\p{{L}} ]+', '', 'g'))::DOUBLE / greatest(length(text), 1) + 0.01::DOUBLE END AS key FROM documents),
 sizes AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM docs GROUP BY source),
 weighed AS (SELECT *, [3.0, 1.0, 2.0][CAST((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS INT)]::DOUBLE AS weight, 2.0::DOUBLE * source_size AS "full", CAST(sum(source_size) OVER () AS DOUBLE) AS total FROM sizes),
 levels AS (SELECT *, "full" / weight AS room, (total * 1.5::DOUBLE - coalesce(sum("full") OVER (ORDER BY "full" / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
  / sum(weight) OVER (ORDER BY "full" / weight, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS lvl FROM weighed),
 aims AS (SELECT source, source_size, least("full", coalesce(max(CASE WHEN lvl <= room THEN lvl END) OVER () * weight, "full")) AS target FROM levels),
 plan AS (SELECT *, CASE WHEN source_size > 0 THEN CAST(floor(target / source_size) AS BIGINT) ELSE 0 END AS epochs FROM aims),
 placed AS (SELECT d.doc_id, d.size, p.source_size, p.target, p.epochs, CAST(floor(p.target - p.epochs * p.source_size) AS BIGINT) AS budget,
  coalesce(sum(d.size) OVER (PARTITION BY d.source ORDER BY d.key, d.doc_id NULLS LAST, d.size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS ahead FROM docs d JOIN plan p ON d.source IS NOT DISTINCT FROM p.source)
SELECT doc_id, size, source_size, target, CAST(epochs * size + greatest(0, least(size, budget - ahead)) AS BIGINT) AS taken FROM placed"""

TOP_K = """WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)) AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
 s AS (SELECT q.vec_id AS query_id, c.vec_id AS vec_id, CAST(list_dot_product(q.e, c.e) AS BIGINT) AS score FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 100 = 0)
SELECT query_id, CAST(rank AS INT) AS rank, vec_id, score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s) WHERE rank <= 10"""

JACCARD = f"""WITH RECURSIVE docs AS (SELECT doc_id, {WORDS.format(LOWERED)} AS w FROM documents),
 sets AS (SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')] ELSE list_distinct(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) END AS s FROM docs),
 sizes AS (SELECT doc_id, CAST(len(s) AS BIGINT) AS n FROM sets),
 one AS (SELECT doc_id, unnest(s) AS g FROM sets),
 pairs AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS common FROM one a JOIN one b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2),
 links AS (SELECT a, b FROM pairs JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b WHERE 100 * common >= 90 * (x.n + y.n - common)),
 edges AS (SELECT a, b FROM links UNION SELECT b, a FROM links),
 reach(a, b) AS (SELECT a, b FROM edges UNION SELECT r.a, e.b FROM reach r JOIN edges e ON r.b = e.a)
SELECT doc_id, n AS n_shingles, least(doc_id, coalesce(least_id, doc_id)) AS component_id FROM sizes LEFT JOIN (SELECT a, min(b) AS least_id FROM reach GROUP BY a) ON a = doc_id"""

LINES = f"""WITH split AS (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents WHERE doc_id IS NOT NULL AND text <> ''),
 lines AS (SELECT doc_id, unnest(l) AS line, unnest(range(0, len(l))) AS n FROM split),
 runs AS (SELECT *, CASE WHEN lead(n, 3) OVER d IS NOT NULL THEN line || chr(10) || lead(line, 1) OVER d || chr(10) || lead(line, 2) OVER d || chr(10) || lead(line, 3) OVER d END AS run FROM lines WINDOW d AS (PARTITION BY doc_id ORDER BY n)),
 seen AS (SELECT *, row_number() OVER (PARTITION BY line ORDER BY doc_id, n) > 1 AND len({WORDS.format("line")}) >= 8 AS again, run IS NOT NULL AND row_number() OVER (PARTITION BY run ORDER BY doc_id, n) > 1 AS run_again FROM runs),
 marked AS (SELECT *, again OR bool_or(run_again) OVER (PARTITION BY doc_id ORDER BY n ROWS BETWEEN 3 PRECEDING AND CURRENT ROW) AS gone FROM seen),
 kept AS (SELECT doc_id, coalesce(string_agg(line, chr(10) ORDER BY n) FILTER (WHERE NOT gone), '') AS text, count(*) FILTER (WHERE gone) AS n_removed, coalesce(string_agg(CAST(n AS VARCHAR), ',' ORDER BY n) FILTER (WHERE gone), '') AS removed_lines FROM marked GROUP BY doc_id)
SELECT d.doc_id, coalesce(n_removed, 0) AS n_removed, coalesce(removed_lines, '') AS removed_lines, md5(coalesce(k.text, d.text)) AS text_md5, CAST(length(coalesce(k.text, d.text)) AS BIGINT) AS text_chars FROM documents d LEFT JOIN kept k USING (doc_id)"""


def oracle_sql() -> dict[str, str]:
    return {"op2_mix_sources": MIX, "op3_exact_top_k": TOP_K, "op4_ngram_jaccard": JACCARD, "op6_line_dedup": LINES}

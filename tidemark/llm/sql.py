"""DuckDB SQL of the training-data queries that SQL can express."""

from __future__ import annotations

from .license_scan import TEMPLATES

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
WORD = r"[^\x20\x09-\x0D]+"


def _lower(x: str) -> str:
    return f"translate({x}, '{UPPER}', '{LOWER}')"


def _grams(name: str, table: str, key: str, k: int) -> str:
    return f"""{name}_w AS (SELECT {key}, regexp_extract_all({_lower("coalesce(text, '')")}, '{WORD}') AS w FROM {table}),
 {name} AS (SELECT DISTINCT {key}, array_to_string(w[i:i+{k - 1}], ' ') AS g FROM (SELECT {key}, w, unnest(range(1, len(w) - {k - 2})) AS i FROM {name}_w WHERE len(w) >= {k}))"""


DECONTAM = f"""WITH {_grams("d", "documents", "doc_id", 5)}, {_grams("b", "benchmark", "item_id", 5)}, q AS (SELECT item_id, count(*) AS q FROM b GROUP BY 1),
 s AS (SELECT doc_id, item_id, count(*) AS shared FROM d JOIN b USING (g) GROUP BY 1, 2)
 SELECT doc_id, item_id, q AS item_shingles, shared FROM s JOIN q USING (item_id) WHERE 100 * shared >= 80 * q"""

QUALITY = rf"""WITH t AS (SELECT doc_id, source AS host, coalesce(text, '') AS x FROM documents), w AS (SELECT doc_id, host, x, regexp_extract_all(x, '{WORD}') AS w FROM t),
 l AS (SELECT doc_id, count(*) AS n_lines, count(*) - count(DISTINCT line) AS n_dup_lines FROM (SELECT doc_id, unnest(string_split(x, chr(10))) AS line FROM t) WHERE regexp_matches(line, '{WORD}') GROUP BY 1),
 r AS (SELECT doc_id, i, array_to_string(w[i:i+7], chr(1)) AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 6)) AS i FROM w WHERE len(w) >= 8)),
 again AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS n FROM r) WHERE n > 1),
 cover AS (SELECT doc_id, count(DISTINCT i + k) AS n_repeat_words FROM again, range(0, 8) z(k) GROUP BY 1),
 m AS (SELECT doc_id, host, len(w) AS n_words, CAST(coalesce(list_sum([length(z) for z in w]), 0) AS BIGINT) AS word_chars, length(regexp_replace(x, '[^#*$%&|<>]', '', 'g')) AS n_symbols, coalesce(n_dup_lines, 0) AS n_dup_lines, coalesce(n_lines, 0) AS n_lines, coalesce(n_repeat_words, 0) AS n_repeat_words FROM w LEFT JOIN l USING (doc_id) LEFT JOIN cover USING (doc_id)),
 f AS (SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed, n_symbols / greatest(word_chars, 1) AS ss, n_dup_lines / greatest(n_lines, 1) AS ds FROM m),
 h AS (SELECT host, count(*) AS docs, count(*) FILTER (base_failed OR ss > 0.1 OR ds > 0.3) AS failures FROM f GROUP BY 1),
 c AS (SELECT sum(failures) / sum(docs) AS p, count(*) AS hosts, sum(docs) AS n FROM h),
 v AS (SELECT p, sum(docs * pow(failures / docs - p, 2)) / max(n) - p * (1 - p) * max(hosts) / max(n) AS v FROM h, c GROUP BY p),
 prior AS (SELECT p, CASE WHEN v > 0 AND p * (1 - p) > 0 THEN greatest(p * (1 - p) / v - 1, 10.0) ELSE 1e6 END AS strength FROM v),
 rates AS (SELECT host, (failures + p * strength) / (docs + strength) AS rate, p FROM h, prior),
 verdicts AS (SELECT host, CASE WHEN rate >= 0.6 THEN 'blocked' WHEN rate >= greatest(0.25, p) THEN 'suspect' WHEN rate <= p THEN 'trusted' ELSE 'plain' END AS verdict FROM rates),
 s AS (SELECT f.*, verdict, CASE verdict WHEN 'suspect' THEN 0.5 WHEN 'trusted' THEN 1 / 0.75 ELSE 1.0 END AS k FROM f JOIN verdicts ON f.host IS NOT DISTINCT FROM verdicts.host)
 SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND verdict <> 'blocked' AND NOT (ss > 0.1 * k OR ds > 0.3 * k) AS kept, verdict FROM s"""

LINES = f"""WITH l AS (SELECT doc_id, unnest(x) AS line, generate_subscripts(x, 1) AS pos FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS x FROM documents)),
 k AS (SELECT *, trim({_lower("line")}, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS key FROM l),
 f AS (SELECT key, max(doc_id) AS owner FROM k WHERE length(key) >= 40 GROUP BY 1 HAVING count(DISTINCT doc_id) >= 5),
 j AS (SELECT k.*, f.key IS NOT NULL AND doc_id <> owner AS gone FROM k LEFT JOIN f USING (key))
 SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped, sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '')) AS kept_sha256 FROM j GROUP BY 1"""

_TEMPLATES = ", ".join("('{}', '{}')".format(k, v.replace("'", "''")) for k, v in TEMPLATES.items())
_NORM = "trim(regexp_replace(lower({}), '[\\x00-\\x2f\\x3a-\\x60\\x7b-\\x7f]+', ' ', 'g'), ' ')"
_BIGRAMS = "list_distinct([w[i] || ' ' || w[i+1] for i in range(1, len(w))])"
LICENCES = f"""WITH t0 AS (SELECT licence, string_split({_NORM.format("body")}, ' ') AS w FROM (VALUES {_TEMPLATES}) v(licence, body)), t AS (SELECT licence, {_BIGRAMS} AS b FROM t0),
 x AS (SELECT doc_id, coalesce(text, '') AS x FROM documents), u AS (SELECT doc_id, unnest(list_concat(string_split(x, chr(10)), list_concat([p for p in regexp_split_to_array(x, '\\n[\\x20\\t\\r]*\\n') if contains(p, chr(10))], CASE WHEN regexp_matches(x, '\\n[\\x20\\t\\r]*\\n') THEN [x] ELSE [] END))) AS unit FROM x),
 w AS (SELECT doc_id, row_number() OVER () AS id, string_split({_NORM.format("unit")}, ' ') AS w FROM u WHERE length(unit) >= 3), b AS (SELECT doc_id, id, {_BIGRAMS} AS b FROM w WHERE len(w) BETWEEN 2 AND 400),
 g AS (SELECT doc_id, id, len(b) AS size, unnest(b) AS g FROM b), tg AS (SELECT licence, len(b) AS t_size, unnest(b) AS g FROM t),
 s AS (SELECT doc_id, id, size, licence, t_size, count(*) AS shared FROM g JOIN tg USING (g) GROUP BY ALL HAVING 200 * count(*) >= 80 * (size + t_size)),
 r AS (SELECT *, shared * 2 / (size + t_size) AS dice, row_number() OVER (PARTITION BY doc_id, licence ORDER BY shared * 2 / (size + t_size) DESC, shared DESC, size DESC, t_size DESC) AS k, count(*) OVER (PARTITION BY doc_id, licence) AS units FROM s)
 SELECT doc_id, licence, units, shared, size, t_size, dice FROM r WHERE k = 1"""

NGRAMS = f"""WITH RECURSIVE ws AS (SELECT doc_id, regexp_extract_all({_lower("coalesce(text, '')")}, '{WORD}') AS w FROM documents),
 g AS (SELECT DISTINCT doc_id, array_to_string(w[i:i+3], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 2)) AS i FROM ws WHERE len(w) >= 4) UNION SELECT doc_id, array_to_string(w, ' ') || chr(1) FROM ws WHERE len(w) BETWEEN 1 AND 3),
 n AS (SELECT doc_id, count(*) AS n FROM g GROUP BY 1),
 p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM g a JOIN g b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2),
 e AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 85 * (x.n + y.n - c)), e2 AS (SELECT a, b FROM e UNION SELECT b, a FROM e),
 reach(v, o) AS (SELECT DISTINCT a, a FROM e2 UNION SELECT e2.b, o FROM reach JOIN e2 ON v = a)
 SELECT d.doc_id, coalesce(n, 0) AS n_shingles, coalesce(m, d.doc_id) AS component_id FROM documents d LEFT JOIN n USING (doc_id) LEFT JOIN (SELECT v, min(o) AS m FROM reach GROUP BY 1) r ON r.v = d.doc_id"""

SQL = {"op2_decontaminate": DECONTAM, "op3_host_quality": QUALITY, "op4_line_dedup": LINES, "op6_license_scan": LICENCES, "op10_ngram_join": NGRAMS}

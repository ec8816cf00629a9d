"""The queries of this subpackage's operators: opN_<name>(spark, sf_dir), and their DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _spread(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``documents`` for operators that are all Python work."""
    from .shared import spread

    return spread(_table(spark, sf_dir, "documents"))


def _vocabulary(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op4_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .bpe import encode_table

    return encode_table(_spread(spark, sf_dir), _vocabulary("word_bpe_49k.json"))


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .packing import pack

    return pack(_spread(spark, sf_dir), _vocabulary("byte_bpe_50k.json"), size=1024, end_id=2)


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import functions as F

    from .line_dedup import dedup

    kept = dedup(_table(spark, sf_dir, "documents").select("doc_id", "text"))
    return kept.select("doc_id", "n_lines", "n_kept", F.sha2("text", 256).alias("text_sha256"))


def op2_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import functions as F

    from .url_filter import RULES, judge

    entries = [F.struct(F.lit(h).alias("host"), F.lit(p).alias("path"), F.lit(v).alias("verdict")) for h, p, v in RULES]
    rules = spark.range(1).select(F.inline(F.array(*entries)))
    return judge(_table(spark, sf_dir, "pages"), rules).select("page_id", "host", "path", "rule", "verdict")


def op3_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .license_scan import scan

    return scan(_table(spark, sf_dir, "documents"))


def op9_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .topk import search

    return search(_table(spark, sf_dir, "embeddings"), k=5, every=50, times=256)


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import functions as F

    from .quality import fit, held_out, score

    docs = _table(spark, sf_dir, "documents")
    scored = score(_spread(spark, sf_dir), fit(docs, _table(spark, sf_dir, "labels")), keep=["doc_id"])
    return scored.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


def op6_vector_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .vector_dedup import near_duplicates

    return near_duplicates(_table(spark, sf_dir, "embeddings"), least=0.98)


def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .simhash import near_duplicates

    return near_duplicates(_spread(spark, sf_dir), words=3, lanes=1, most=2, m=3)


def op8_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .token_files import write_and_read

    return write_and_read(_table(spark, sf_dir, "documents"), _vocabulary("byte_bpe_50k.json"), end_id=2)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_line_dedup, op2_url_filter, op3_license_scan, op4_bpe, op5_packing, op6_vector_dedup, op7_simhash, op8_token_files, op9_topk, op10_quality)}


def oracle_sql() -> dict[str, str]:
    return {"op1_line_dedup": LINE_DEDUP_SQL, "op2_url_filter": _url_filter_sql(), "op3_license_scan": LICENSE_SCAN_SQL, "op6_vector_dedup": VECTOR_DEDUP_SQL, "op9_topk": TOPK_SQL}


#: Letters beyond ASCII stand as one control character each, since levenshtein() counts bytes.
_LETTERS = "äöüßÄÖÜéèêçÉÈÊÇáíóúñÁÍÓÚÑ"
_CONTROLS = " || ".join(f"chr({k})" for k in range(1, len(_LETTERS) + 1 + 1) if k != 10)
LINE_DEDUP_SQL = f"""
WITH RECURSIVE docs AS (SELECT doc_id, text, string_split(text, chr(10)) AS parts FROM documents),
lines AS (SELECT doc_id, text, unnest(parts) AS line, generate_subscripts(parts, 1) AS pos FROM docs),
firsts AS (
  SELECT line, length(line) AS n, min(row(doc_id, pos)) AS place, translate(line, '{_LETTERS}', {_CONTROLS}) AS plain
  FROM lines WHERE length(line) > 0 GROUP BY line),
near AS (
  SELECT a.line AS a, b.line AS b FROM firsts a JOIN firsts b
  ON a.n >= 16 AND b.n >= 16 AND b.n BETWEEN a.n - 2 AND a.n + 2 AND a.line <> b.line AND levenshtein(a.plain, b.plain) <= 2),
reach(a, b) AS (SELECT a, b FROM near UNION SELECT r.a, n.b FROM reach r JOIN near n ON r.b = n.a),
ahead AS (
  SELECT f.line, least(f.place, min(g.place)) AS place
  FROM firsts f LEFT JOIN reach r ON f.line = r.a LEFT JOIN firsts g ON r.b = g.line GROUP BY f.line, f.place),
kept AS (
  SELECT l.doc_id, count(*) AS n, string_agg(l.line, chr(10) ORDER BY l.pos) AS text
  FROM lines l LEFT JOIN ahead a ON l.line = a.line
  WHERE length(l.line) = 0 OR a.place = row(l.doc_id, l.pos) GROUP BY l.doc_id)
SELECT d.doc_id, CAST(coalesce(len(d.parts), 0) AS BIGINT) AS n_lines, CAST(coalesce(k.n, 0) AS BIGINT) AS n_kept,
  CASE WHEN d.text IS NOT NULL THEN sha256(coalesce(k.text, '')) END AS text_sha256
FROM docs d LEFT JOIN kept k ON d.doc_id = k.doc_id
"""

VECTOR_DEDUP_SQL = """
WITH RECURSIVE v AS (
  SELECT vec_id, label, n, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS e
  FROM (SELECT *, row_number() OVER () AS n FROM embeddings)
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
links AS (
  SELECT a.n, a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.label = b.label AND a.n <> b.n AND len(a.e) = len(b.e)
  WHERE list_dot_product(a.e, b.e) / (sqrt(list_dot_product(a.e, a.e)) * sqrt(list_dot_product(b.e, b.e))) >= 0.98),
reach(a, b) AS (SELECT a, b FROM links UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a),
smallest AS (SELECT a, min(b) AS b FROM reach GROUP BY a),
numbers AS (SELECT n, count(*) AS k FROM links GROUP BY n),
rows_ AS (SELECT e.vec_id, v.n FROM (SELECT *, row_number() OVER () AS i FROM embeddings) e LEFT JOIN v ON e.i = v.n AND e.vec_id = v.vec_id)
SELECT r.vec_id, CAST(coalesce(k, 0) AS BIGINT) AS n_links, least(r.vec_id, coalesce(s.b, r.vec_id)) AS component_id,
  r.vec_id IS NOT DISTINCT FROM least(r.vec_id, coalesce(s.b, r.vec_id)) AS kept
FROM rows_ r LEFT JOIN numbers USING (n) LEFT JOIN smallest s ON s.a = r.vec_id
"""

TOPK_SQL = """
WITH v AS (
  SELECT vec_id, row_number() OVER () AS n, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS DOUBLE)) AS e
  FROM embeddings
  WHERE vec_id IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT q.n, q.vec_id AS query_id, c.vec_id, CAST(list_dot_product(q.e, c.e) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id % 50 = 0 AND c.vec_id <> q.vec_id AND len(q.e) = len(c.e)),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY n ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
"""


def _url_filter_sql() -> str:
    from .url_filter import LOWER, PARTS, RULES, UPPER

    rules = ", ".join(f"('{h}', '{p}', '{v}')" for h, p, v in RULES)
    return f"""
    WITH rules(h, p, v) AS (VALUES {rules}),
    urls AS (
      SELECT page_id, row_number() OVER () AS n,
        translate(coalesce(regexp_extract(url, '{PARTS}', 1), ''), '{UPPER}', '{LOWER}') AS host,
        coalesce(regexp_extract(url, '{PARTS}', 2), '') AS path
      FROM pages),
    fits AS (
      SELECT n, h || p AS rule, v, row_number() OVER (PARTITION BY n ORDER BY length(h || p) DESC, length(h) DESC) AS k
      FROM urls JOIN rules ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p))
    SELECT page_id, host, path, rule, coalesce(v, 'allow') AS verdict
    FROM urls LEFT JOIN (SELECT * FROM fits WHERE k = 1) USING (n)
    """


#: The notices stand here once more, so that a slip in the operator's own table shows. In the tables that the query is
#: compared on, every match is one line; passages are compared with brute force in the tests.
LICENSE_SCAN_SQL = """
WITH notices(name, t) AS (VALUES
  ('Apache-2.0', 'Licensed under the Apache License, Version 2.0.'),
  ('Apache-2.0', 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License.'),
  ('BSD-3-Clause', 'Use of this source code is governed by a BSD-style license that can be found in the LICENSE file.'),
  ('CC-BY-4.0', 'This work is licensed under a Creative Commons Attribution 4.0 International License.'),
  ('CC-BY-NC-4.0', 'Licensed under CC BY-NC 4.0.'),
  ('CC-BY-SA-4.0', 'This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.'),
  ('CC0-1.0', 'To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work.'),
  ('GPL-3.0', 'This work is licensed under the GNU General Public License, version 3.'),
  ('GPL-3.0-or-later', 'This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.'),
  ('MIT', 'Released under the MIT License.'),
  ('MIT', 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the Software without restriction.'),
  ('MPL-2.0', 'This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.'),
  ('reserved', 'All rights reserved.')),
templates AS (
  SELECT name, list_distinct(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) AS g
  FROM (SELECT name, regexp_extract_all(lower(t), '[a-z0-9]+') AS w FROM notices)),
lines AS (
  SELECT n, unnest(string_split(text, chr(10))) AS line
  FROM (SELECT row_number() OVER () AS n, coalesce(text, '') AS text FROM documents)),
worded AS (SELECT n, regexp_extract_all(translate(line, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-z0-9]+') AS w FROM lines),
grams AS (
  SELECT n, row_number() OVER () AS u, list_distinct(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) AS g
  FROM worded),
best AS (
  SELECT n, u, max(struct_pack(dice := len(list_intersect(grams.g, templates.g)) * 2 / (len(grams.g) + len(templates.g)), name := name)) AS b
  FROM grams JOIN templates ON len(grams.g) * 3 >= len(templates.g) * 2 - 1e-6 AND len(grams.g) * 2 <= len(templates.g) * 3 + 1e-6
  GROUP BY n, u),
hits AS (
  SELECT n, count(*) AS k, string_agg(DISTINCT b.name, ',' ORDER BY b.name) AS licenses, max(b.dice) AS dice
  FROM best WHERE b.dice >= 0.8 GROUP BY n)
SELECT doc_id, CAST(len(string_split(coalesce(text, ''), chr(10))) AS BIGINT) AS n_lines,
  CAST(coalesce(k, 0) AS BIGINT) AS n_license_lines, coalesce(licenses, '') AS licenses, dice AS best_dice
FROM (SELECT *, row_number() OVER () AS n FROM documents) LEFT JOIN hits USING (n)
"""

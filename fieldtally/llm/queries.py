"""The thin queries over the given tables, one per operator."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldtally.llm.common import table

Query = Callable[[SparkSession, str], DataFrame]


def op7_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    from fieldtally.llm.secrets import scan_secrets, span_text

    found = scan_secrets(table(spark, sf_dir, "documents"))
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long")
    return found.select(
        "doc_id",
        *[count(k).alias(f"n_{k}") for k in ("assign", "access", "hex")],
        F.col("base_digest").alias("base_sha256"),
        span_text(F.col("spans")).alias("spans"),
    )


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from public_tokenizers import path

    from fieldtally.llm.packing import pack

    return pack(table(spark, sf_dir, "documents"), path("word_bpe_49k.json"))


def op1_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    from fieldtally.llm.ann import build_index, search_index

    vectors = table(spark, sf_dir, "embeddings")
    return search_index(build_index(vectors, k=5), vectors, F.col("id") % 50 == 0, k=5)


def op2_pieces_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    from public_tokenizers import path

    from fieldtally.llm.pieces import encode_round_trip

    return encode_round_trip(table(spark, sf_dir, "documents"), path("piece_bpe_32k.model"))


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from fieldtally.llm.toxicity import fit, score_toxicity

    docs = table(spark, sf_dir, "documents")
    # A row without id is no labelled one, so nothing is learnt from it: it is not held out.
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2, F.lit(False))
    model = fit(docs, table(spark, sf_dir, "labels"), train_on=~held_out)
    return score_toxicity(docs, model).select(
        "doc_id", held_out.alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted")
    )


def op4_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from fieldtally.llm.simhash import near_duplicates

    return near_duplicates(table(spark, sf_dir, "documents"))


def op5_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    from fieldtally.llm.exact_topk import exact_topk

    return exact_topk(table(spark, sf_dir, "embeddings"), F.col("id") % 100 == 0, k=10, scale=1024.0)


def trusted_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of the documents that are labelled as good text."""
    labels = table(spark, sf_dir, "labels")
    return labels.where("doc_id IS NOT NULL AND quality = 1").select(F.col("doc_id").alias("id")).distinct()


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from fieldtally.llm.quality import score

    out = score(table(spark, sf_dir, "documents"), trusted_ids(spark, sf_dir))
    keep = F.coalesce(F.col("nats") <= F.col("threshold"), F.lit(True)).cast("int")
    return out.select(F.col("id").alias("doc_id"), "lang", "n_words", F.exp("nats").alias("perplexity"), F.exp("threshold").alias("threshold"), keep.alias("keep"))


def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from fieldtally.llm.lines import remove_boilerplate

    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    cleaned = remove_boilerplate(docs)
    return cleaned.select("doc_id", "n_lines", "n_removed", F.sha2("text", 256).alias("text_sha256"))


# The url rules.
URL_RULES = [
    ("allow", "com/"),
    ("block", "example.com/en/"),
    ("allow", "www.example.com/en/"),
    ("block", "net/es/"),
    ("block", "net/fr/"),
]


def op10_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    from fieldtally.llm.urls import judge_urls

    pages = table(spark, sf_dir, "pages")
    judged = judge_urls(pages, URL_RULES, pages, "html")
    return judged.select("page_id", "host", "path", "rule", "verdict", F.array_join("words", " ").alias("words"), "score")


def op11_similar_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    from fieldtally.llm.permutations import similar_links

    return similar_links(table(spark, sf_dir, "embeddings"), threshold=0.93)


def op12_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    from fieldtally.llm.repair import repair_conversations

    return repair_conversations(table(spark, sf_dir, "conversations"), damaged=True)


def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    from fieldtally.llm.periodic import periodic_runs, with_planted_runs

    return periodic_runs(with_planted_runs(table(spark, sf_dir, "documents").select("doc_id", "text")))


def queries() -> dict[str, Query]:
    return {
        "op1_nearest_neighbours": op1_nearest_neighbours,
        "op2_pieces_round_trip": op2_pieces_round_trip,
        "op3_toxicity": op3_toxicity,
        "op4_simhash_dedup": op4_simhash_dedup,
        "op5_exact_topk": op5_exact_topk,
        "op8_packing": op8_packing,
        "op6_quality": op6_quality,
        "op7_secret_scans": op7_secret_scans,
        "op9_line_dedup": op9_line_dedup,
        "op10_url_filters": op10_url_filters,
        "op11_similar_links": op11_similar_links,
        "op12_conversation_repair": op12_conversation_repair,
        "op13_periodic_runs": op13_periodic_runs,
    }


OP9_SQL = """
WITH lines AS (
  SELECT doc_id, source, generate_subscripts(parts, 1) AS pos, unnest(parts) AS line
  FROM (SELECT doc_id, source, string_split(text, chr(10)) AS parts FROM documents WHERE text IS NOT NULL)
), spread AS (
  SELECT trim(line, ' ') AS t, count(DISTINCT source) AS sites, min(doc_id) AS keep_doc
  FROM lines WHERE trim(line, ' ') <> '' GROUP BY 1
), first_at AS (
  SELECT s.t, s.keep_doc, min(l.pos) AS keep_pos
  FROM spread s JOIN lines l ON trim(l.line, ' ') = s.t AND l.doc_id = s.keep_doc
  WHERE s.sites >= 10 GROUP BY 1, 2
), marked AS (
  SELECT l.doc_id, l.pos, l.line,
         f.t IS NOT NULL AND NOT (l.doc_id = f.keep_doc AND l.pos = f.keep_pos) AS gone
  FROM lines l LEFT JOIN first_at f ON trim(l.line, ' ') = f.t
)
SELECT doc_id, count(*) AS n_lines, CAST(sum(CAST(gone AS INTEGER)) AS BIGINT) AS n_removed,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '')) AS text_sha256
FROM marked GROUP BY doc_id
"""

OP5_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS DOUBLE)) AS e
  FROM embeddings
  WHERE embedding IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id AS vec_id,
         CAST(list_inner_product(q.e, c.e) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id
  WHERE q.vec_id % 100 = 0
), r AS (
  SELECT query_id, vec_id, score,
         CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank
  FROM s
)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 10
"""


OP11_SQL = """
WITH RECURSIVE v AS (
  SELECT vec_id, label, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS e
  FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0
), links AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id
  WHERE list_cosine_similarity(a.e, b.e) >= 0.93
), reach(a, b) AS (
  SELECT a, b FROM links
  UNION
  SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a
)
SELECT vec_id, coalesce(n, 0) AS n_links, least(vec_id, coalesce(least_id, vec_id)) AS component_id,
       vec_id = least(vec_id, coalesce(least_id, vec_id)) AS kept
FROM embeddings
LEFT JOIN (SELECT a AS vec_id, count(*) AS n FROM links GROUP BY 1) USING (vec_id)
LEFT JOIN (SELECT a AS vec_id, min(b) AS least_id FROM reach GROUP BY 1) USING (vec_id)
"""

#: crc32 of ASCII text in ``{0}``, bit by bit.
CRC32_SQL = """xor(4294967295, list_reduce(list_prepend(4294967295, list_transform(string_split({0}, ''), lambda c: CAST(ascii(c) AS BIGINT))),
  lambda h, c: list_reduce(list_prepend(xor(h, c), [0, 0, 0, 0, 0, 0, 0, 0]), lambda x, z: xor(x >> 1, (x & 1) * 3988292384))))"""


def _op12_sql() -> str:
    """Rows are folded from the last: for each state (nothing, s, u, a) the least
    (cost, audit) of what follows, with the repaired text."""
    follows = [2, 2, 3, 2]
    better = lambda options: f"list_min([{', '.join(options)}])"
    # An option is {c: cost, a: audit, t: text}; the audit tells the text.
    role = {2: "user", 3: "assistant"}
    option = lambda to, cost, letter, text: f"{{'c': v{to}.c + {cost}, 'a': '{letter}' || v{to}.a, 't': {text} || v{to}.t}}"
    bases, closed = [], []
    for s, n in enumerate(follows):
        keep = [f"CASE WHEN stays AND initial = '{'s' if k == 1 else 'u' if k == 2 else 'a'}' THEN {option(k, 'more', 'K', 'role || chr(58) || text || chr(10)')} END" for k in ([1, 2] if s == 0 else [n])]
        give = f"CASE WHEN stays THEN {option(n, '3 + more', 'R', repr(role[n]) + ' || chr(58) || text || chr(10)')} END"
        bases.append(f"{better([option(s, 4, 'D', repr('')), *keep, give])} AS b{s}")
        line = {k: f"'{r}:' || chr(10)" for k, r in role.items()}
        once = f"{{'c': b{n}.c + 3, 'a': 'I' || b{n}.a, 't': {line[n]} || b{n}.t}}"
        m = follows[n]
        twice = f"{{'c': b{m}.c + 6, 'a': 'II' || b{m}.a, 't': {line[n]} || {line[m]} || b{m}.t}}"
        closed.append(f"{better([f'b{s}', once, twice])} AS v{s}")
    end = [
        "{'c': 0, 'a': '', 't': ''}", "{'c': 6, 'a': 'II', 't': 'user:' || chr(10) || 'assistant:' || chr(10)}",
        "{'c': 3, 'a': 'I', 't': 'assistant:' || chr(10)}", "{'c': 0, 'a': '', 't': ''}",
    ]
    ends = ", ".join(f"CAST({e} AS STRUCT(c BIGINT, a VARCHAR, t VARCHAR)) AS v{s}" for s, e in enumerate(end))
    crc = CRC32_SQL.format("coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ')")
    return f"""
WITH RECURSIVE hashed AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, {crc} % 20 AS kind FROM conversations
), damaged AS (
  SELECT conv_id, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role,
         CASE WHEN kind = 1 THEN '' WHEN kind = 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
         unnest(CASE WHEN kind = 3 THEN [1, 2] ELSE [1] END) AS copy
  FROM hashed WHERE kind <> 0
), numbered AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, copy) AS i,
         right(rtrim(text, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 1) AS final, left(role, 1) AS initial
  FROM damaged
), seen AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 AS again,
         lag(initial) OVER (PARTITION BY conv_id ORDER BY i) AS before
  FROM numbered
), judged AS (
  SELECT *, final = '' AS blank, final <> '' AND again AS duplicate, final <> '' AND NOT again AND final NOT IN ('.', '!', '?') AS truncated,
         before IS NOT NULL AND before || initial NOT IN ('su', 'ua', 'au') AS illegal
  FROM seen
), items AS (
  SELECT conv_id, i, role, text, initial, NOT blank AND NOT duplicate AS stays, CASE WHEN truncated THEN 3 ELSE 0 END AS more FROM judged
), counts AS (
  SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (blank) AS blank,
         count(*) FILTER (duplicate) AS duplicate, count(*) FILTER (truncated) AS truncated, count(*) FILTER (illegal) AS illegal, max(i) AS n
  FROM judged GROUP BY conv_id
), dp AS (
  SELECT conv_id, n + 1 AS i, {ends} FROM counts
  UNION ALL
  SELECT conv_id, i, {', '.join(closed)} FROM (
    SELECT dp.conv_id AS conv_id, items.i AS i, {', '.join(bases)}
    FROM dp JOIN items ON items.conv_id IS NOT DISTINCT FROM dp.conv_id AND items.i = dp.i - 1)
), best AS (SELECT conv_id, v0 FROM dp WHERE i = 1)
SELECT c.conv_id, CAST(coalesce(gaps, 0) AS BIGINT) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate,
       coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal, coalesce(v0.c, 0) AS cost, coalesce(v0.a, '') AS audit,
       sha256(coalesce(left(v0.t, length(v0.t) - 1), '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) c
LEFT JOIN counts ON counts.conv_id IS NOT DISTINCT FROM c.conv_id
LEFT JOIN best ON best.conv_id IS NOT DISTINCT FROM c.conv_id
"""


def oracle_sql() -> dict[str, str]:
    return {"op5_exact_topk": OP5_SQL, "op9_line_dedup": OP9_SQL, "op11_similar_links": OP11_SQL, "op12_conversation_repair": _op12_sql()}

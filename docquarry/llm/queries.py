"""The registered queries of the training-data operators, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_simhash_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    from docquarry.llm.simhash import near_duplicates

    return near_duplicates(table(spark, sf_dir, "documents"))


def op2_media_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    from docquarry.llm.media import media_column

    return media_column(table(spark, sf_dir, "documents"))


def op3_preference_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    from docquarry.llm.preferences import digests, preferences

    return digests(preferences(table(spark, sf_dir, "conversations")))


def op4_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    from docquarry.llm.secrets import scan

    return scan(table(spark, sf_dir, "documents")).drop("literals")


def op5_piece_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    from docquarry.llm.pieces import round_trip

    return round_trip(table(spark, sf_dir, "documents"))


def op6_quality_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    from docquarry.llm.quality import classify

    return classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op7_language_hierarchy(spark: SparkSession, sf_dir: str) -> DataFrame:
    from docquarry.llm.language import identify

    return identify(table(spark, sf_dir, "documents"))


def op8_multiset_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    from docquarry.llm.fingerprint import edited

    return edited(table(spark, sf_dir, "documents"))


def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from docquarry.llm.linededup import dedup_lines

    return dedup_lines(table(spark, sf_dir, "documents"))


def op10_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    from docquarry.llm.mixing import mix

    return mix(table(spark, sf_dir, "documents"))


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    from docquarry.llm.runs import planted, runs

    return runs(table(spark, sf_dir, "documents"), "doc_id", text=planted())


def op12_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    from docquarry.llm.collocations import collocations

    return collocations(table(spark, sf_dir, "documents"))


def op13_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    from docquarry.llm.personal import find_personal

    return find_personal(table(spark, sf_dir, "documents"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    from corpus_pipeline import run

    return run(spark, sf_dir)


def draw_rounds(rounds: int) -> str:
    """The rounds of draws: each draws three quarters of the slots that are left, by what the sources still lack."""
    out = ""
    for k in range(rounds):
        high = "total" if k == rounds - 1 else f"total - (total >> {2 * k + 2})"
        out += f"""
), lack{k} AS (
  SELECT *, greatest(slots - got, 0) AS lack, sum(greatest(slots - got, 0)) OVER (ORDER BY rank) AS upto FROM state{k}
), slot{k} AS (
  SELECT ('0x' || md5('mix|' || id)[1:15])::BIGINT % (SELECT sum(lack) FROM lack{k}) AS spot
  FROM (SELECT unnest(range(total - (total >> {2 * k}), {high})) AS id FROM (SELECT sum(slots)::BIGINT AS total FROM quotas))
), state{k + 1} AS (
  SELECT l.rank, any_value(l.slots) AS slots, any_value(l.blocks) AS blocks, any_value(l.got) + least(count(spot), any_value(l.blocks) * 2 - any_value(l.got)) AS got
  FROM lack{k} l LEFT JOIN slot{k} d ON d.spot >= l.upto - l.lack AND d.spot < l.upto GROUP BY l.rank"""
    return out


MIX_SQL = (
    r"""
WITH sized AS (
  SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size FROM documents
), stats AS (
  SELECT source, sum(size)::BIGINT AS source_size, count(*) AS source_docs FROM sized GROUP BY source
), ranked AS (
  SELECT *, row_number() OVER (ORDER BY source ASC NULLS LAST) - 1 AS rank FROM stats
), weighed AS (
  SELECT *, [5, 2, 1][(rank % 3 + 1)::INT]::BIGINT AS weight, source_size * 2 AS ceiling FROM ranked
), rated AS (
  SELECT *, ceiling / weight AS ratio, sum(source_size) OVER () * 1.5::DOUBLE AS total FROM weighed
), levelled AS (
  SELECT *, row_number() OVER w AS pos,
    (total - coalesce(sum(ceiling) OVER (ORDER BY ratio, rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::DOUBLE)
      / (sum(weight) OVER (ORDER BY ratio, rank ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))::DOUBLE AS level
  FROM rated WINDOW w AS (ORDER BY ratio, rank)
), opened AS (
  SELECT *, min(CASE WHEN level <= ratio THEN pos END) OVER () AS first_at FROM levelled
), planned AS (
  SELECT source, rank, source_docs, source_size,
    CASE WHEN pos < first_at THEN ceiling::DOUBLE ELSE weight * max(CASE WHEN pos = first_at THEN level END) OVER () END AS target, 16 AS block
  FROM opened
), plan AS (
  SELECT *, (source_size + block - 1) // block AS blocks, (source_docs + 999) // 1000 AS buckets FROM planned
), quotas AS (
  SELECT *, CASE WHEN source_size > 0 THEN least(blocks * 2, floor(blocks * target / source_size + 0.5)::BIGINT) ELSE 0 END AS slots,
    [2305843009213693951, 2305843009213693921, 2305843009213693907, 2305843009213693723][((('0x' || md5('mix|' || rank)[1:15])::BIGINT) % 4 + 1)::INT] AS prime,
    ('0x' || md5('mix+|' || rank)[1:15])::BIGINT AS mover
  FROM plan
), state0 AS (
  SELECT rank, slots, blocks, 0::BIGINT AS got FROM quotas"""
    + draw_rounds(5)
    + r"""
), dealt AS (
  SELECT s.doc_id, s.size, q.*, (('0x' || md5(concat_ws('|', s.doc_id, s.size))[1:15])::BIGINT) % q.buckets AS bucket
  FROM sized s JOIN quotas q ON s.source IS NOT DISTINCT FROM q.source
), placed AS (
  SELECT *, row_number() OVER () AS row_no,
    (sum(size) OVER (PARTITION BY rank ORDER BY bucket, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - size)::BIGINT AS start
  FROM dealt
), slot AS (
  SELECT rank, unnest(range(state5.got)) AS n, q.blocks, prime, mover FROM quotas q JOIN state5 USING (rank) WHERE state5.got > 0
), times AS (
  SELECT rank, (((prime % blocks)::HUGEINT * (n % blocks)::HUGEINT + mover % blocks) % blocks)::BIGINT AS idx, count(*) AS times FROM slot GROUP BY 1, 2
), spans AS (
  SELECT row_no, rank, start, size, block, unnest(range(start // block, (start + size - 1) // block + 1)) AS idx FROM placed WHERE size > 0
), taken AS (
  SELECT row_no, sum(times * (least(start + size, (idx + 1) * block) - greatest(start, idx * block))) AS taken
  FROM spans JOIN times USING (rank, idx) GROUP BY row_no
)
SELECT doc_id, size, source_size, target, coalesce(taken, 0)::BIGINT AS taken, source FROM placed LEFT JOIN taken USING (row_no)
"""
)

LINE_SQL = r"""
WITH texts AS (
  SELECT row_number() OVER () AS row_no, doc_id, coalesce(text, '') AS text FROM documents
), lines AS (
  SELECT row_no, doc_id, unnest(string_split(text, chr(10))) AS line, unnest(range(len(string_split(text, chr(10))))) AS ord FROM texts
), keyed AS (
  SELECT *, translate(regexp_replace(line, '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM lines
), repeated AS (
  SELECT key, max(doc_id) AS keeps FROM keyed WHERE length(key) >= 20 GROUP BY key HAVING count(DISTINCT doc_id) >= 3
), marked AS (
  SELECT k.*, r.key IS NOT NULL AND k.doc_id <> r.keeps AS lost FROM keyed k LEFT JOIN repeated r ON k.key = r.key
)
SELECT any_value(doc_id) AS doc_id, count(*)::BIGINT AS n_lines, count(*) FILTER (WHERE lost)::BIGINT AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY ord) FILTER (WHERE NOT lost), '')) AS kept_sha256
FROM marked GROUP BY row_no
"""

PREFERENCE_SQL = """
WITH given AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
), talks AS (
  SELECT conv_id, list({'role': role, 'text': text} ORDER BY turn NULLS FIRST, role, text) AS turns FROM given GROUP BY conv_id
), known AS (
  SELECT *, CASE WHEN list_position(list_transform(turns, lambda t: t.role), 'user') > 0
      THEN turns[1:list_position(list_transform(turns, lambda t: t.role), 'user')] ELSE turns END AS opening,
    coalesce(list_sum(list_transform(turns, lambda t: CASE WHEN t.role = 'assistant' THEN length(t.text) ELSE 0 END)), 0) AS said,
    list_max(list_transform(range(1, len(turns) + 1), lambda i: CASE WHEN turns[i].role = 'assistant' THEN i END)) AS last
  FROM talks
), chained AS (
  SELECT conv_id, turns, said, lead(conv_id) OVER w AS other_id, lead(turns) OVER w AS other, lead(said) OVER w AS other_said
  FROM known WINDOW w AS (PARTITION BY opening ORDER BY conv_id NULLS FIRST)
), pairs AS (
  SELECT 'prompt' AS source, CASE WHEN other_said > said THEN other_id ELSE conv_id END AS chosen_id, CASE WHEN other_said > said THEN conv_id ELSE other_id END AS rejected_id,
    CASE WHEN other_said > said THEN other ELSE turns END AS a, CASE WHEN other_said > said THEN turns ELSE other END AS b
  FROM chained WHERE other IS NOT NULL
  UNION ALL
  SELECT 'stale', conv_id, conv_id, turns[1:last], list_append(turns[1:last - 1], {'role': 'assistant', 'text': coalesce(
      list_filter(turns[1:last - 1], lambda t: t.role = 'assistant')[-1].text, list_filter(turns[1:last - 1], lambda t: t.role = 'user')[-1].text, '')})
  FROM known WHERE last IS NOT NULL
), cut AS (
  SELECT *, coalesce(list_min(list_transform(range(1, least(len(a), len(b)) + 1), lambda i: CASE WHEN a[i] <> b[i] THEN i END)) - 1, least(len(a), len(b))) AS n FROM pairs
), parts AS (
  SELECT source, chosen_id, rejected_id, n, a[1:n] AS p, a[n + 1:] AS x, b[n + 1:] AS y FROM cut
), lined AS (
  SELECT *, list_transform(p, lambda t: '<|' || t.role || '|>' || chr(10) || t.text || '<|end|>' || chr(10)) AS ps,
    list_transform(x, lambda t: '<|' || t.role || '|>' || chr(10) || t.text || '<|end|>' || chr(10)) AS xs,
    list_transform(y, lambda t: '<|' || t.role || '|>' || chr(10) || t.text || '<|end|>' || chr(10)) AS ys
  FROM parts
)
SELECT source, chosen_id, rejected_id, n::BIGINT AS prompt_turns, sha256(array_to_string(ps, '')) AS prompt_sha256,
  sha256(array_to_string(xs, '')) AS chosen_sha256, sha256(array_to_string(ys, '')) AS rejected_sha256,
  array_to_string(list_transform(list_filter(range(1, len(x) + 1), lambda i: x[i].role = 'assistant'), lambda i:
    (length(array_to_string(xs[1:i], '')) - length(x[i].text) - 8)::VARCHAR || ':' || length(array_to_string(xs[1:i], ''))::VARCHAR), ',') AS chosen_mask,
  array_to_string(list_transform(list_filter(range(1, len(y) + 1), lambda i: y[i].role = 'assistant'), lambda i:
    (length(array_to_string(ys[1:i], '')) - length(y[i].text) - 8)::VARCHAR || ':' || length(array_to_string(ys[1:i], ''))::VARCHAR), ',') AS rejected_mask,
  len(x) > 0 OR len(y) > 0 AS differs
FROM lined
"""

PHRASE_SQL = r"""
WITH pieces AS (
  SELECT row_number() OVER () AS piece, lang, words FROM (
    SELECT lang, list_filter(string_split_regex(piece, '[\x20\x09]'), lambda w: w <> '') AS words FROM (
      SELECT coalesce(lang, 'und') AS lang,
        unnest(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents))
  WHERE len(words) > 0
), places AS (
  SELECT lang, words, unnest(range(1, len(words) + 1)) AS spot FROM pieces
), grams AS (
  SELECT lang, words, spot, unnest(range(1, least(5, len(words) - spot + 1) + 1)) AS size FROM places
), counts AS (
  SELECT lang, size, phrase, count(*) AS n FROM (SELECT lang, size, array_to_string(words[spot:spot + size - 1], ' ') AS phrase FROM grams) GROUP BY ALL
), total AS (
  SELECT lang, sum(n) AS total FROM counts WHERE size = 1 GROUP BY lang
), often AS (
  SELECT *, string_split(phrase, ' ') AS words FROM counts WHERE n >= 100
), cuts AS (
  SELECT lang, phrase, size, n AS a, unnest(range(1, size)) AS k, words FROM often WHERE size > 1
), scored AS (
  SELECT c.lang, c.phrase, c.size, c.a, c.k, f.n AS l, g.n AS r, t.total AS n, (1000::HUGEINT * c.a * t.total::HUGEINT) // (f.n::HUGEINT * g.n) AS score
  FROM cuts c JOIN often f ON f.lang = c.lang AND f.phrase = array_to_string(c.words[1:c.k], ' ')
    JOIN often g ON g.lang = c.lang AND g.phrase = array_to_string(c.words[c.k + 1:], ' ') JOIN total t ON t.lang = c.lang
), best AS (
  SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1
), inner_parts AS (
  SELECT lang, n AS most, array_to_string(words[lo:hi], ' ') AS phrase FROM (
    SELECT lang, n, words, lo, unnest(range(lo + 1, size + 1)) AS hi, size FROM (SELECT *, unnest(range(1, size)) AS lo FROM often WHERE size > 2)) WHERE hi - lo + 1 < size
), lone AS (
  SELECT b.* FROM best b LEFT JOIN (SELECT lang, phrase, max(most) AS most FROM inner_parts GROUP BY ALL) i ON i.lang = b.lang AND i.phrase = b.phrase
  WHERE i.most IS NULL OR 100 * i.most < 100 * b.a
)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase)::BIGINT AS rank, phrase,
  a::BIGINT AS a, l::BIGINT AS l, r::BIGINT AS r, n::BIGINT AS n, score::BIGINT AS score
FROM lone QUALIFY row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) <= 2000
"""

QUERIES: dict[str, Query] = {
    "op1_simhash_links": op1_simhash_links,
    "op2_media_chunks": op2_media_chunks,
    "op3_preference_pairs": op3_preference_pairs,
    "op4_secret_scan": op4_secret_scan,
    "op5_piece_round_trip": op5_piece_round_trip,
    "op6_quality_neighbours": op6_quality_neighbours,
    "op7_language_hierarchy": op7_language_hierarchy,
    "op8_multiset_fingerprints": op8_multiset_fingerprints,
    "op9_line_dedup": op9_line_dedup,
    "op10_mix_sources": op10_mix_sources,
    "op11_periodic_runs": op11_periodic_runs,
    "op12_collocations": op12_collocations,
    "op13_personal_data": op13_personal_data,
    "pipeline": pipeline,
}
ORACLE: dict[str, str] = {"op3_preference_pairs": PREFERENCE_SQL, "op9_line_dedup": LINE_SQL, "op10_mix_sources": MIX_SQL, "op12_collocations": PHRASE_SQL}

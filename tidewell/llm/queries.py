"""Queries opN_<name>: each operator over its whole table with production parameters, and its SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

Query = Callable[[SparkSession, str], DataFrame]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidewell.llm.sharding import assign_shards

    found = assign_shards(table(spark, sf_dir, "documents").select("doc_id", "text"), n_shards=16)
    return found.select("doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard")


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidewell.llm.quality_rules import apply_rules

    found = apply_rules(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op4_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidewell.llm.exact_dedup import decisions

    found = decisions(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidewell.llm.mixing import mix, taken_words

    found = taken_words(*mix(table(spark, sf_dir, "documents").select("doc_id", "text", "source")))
    return found.select(F.col("key_").alias("doc_id"), "size", "source_size", "target", "taken")


def op6_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from tidewell.llm.byte_bpe import encode_digest, load_ranks

    documents = table(spark, sf_dir, "documents").select("doc_id", "text")
    return encode_digest(documents, load_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken")), public_tokenizers.PATTERN)


def fold_of(key: str, folds: int):
    """crc32 of the id as text, modulo ``folds``; a null id counts as the empty text."""
    return F.pmod(F.crc32(F.coalesce(F.col(key).cast("string"), F.lit(""))), F.lit(folds))


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidewell.llm.language_id import fit, identify

    documents = table(spark, sf_dir, "documents").select("doc_id", "text", "lang").withColumn("held_out", fold_of("doc_id", 4) == 2)
    model = fit(documents.where(~F.col("held_out")))
    found = identify(documents.select("doc_id", "text", "held_out"), model, keep_text=False)
    return found.select("doc_id", "held_out", "lang_pred", "score")


def op7_quality_crf(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidewell.llm.quality_crf import fit, score

    documents = table(spark, sf_dir, "documents").select("doc_id", "text").withColumn("held_out", fold_of("doc_id", 4) == 2)
    labels = table(spark, sf_dir, "labels").select("doc_id", "quality")
    field = fit(documents.where(~F.col("held_out")), labels.where(fold_of("doc_id", 4) != 2))
    found = score(documents, field, keep_text=False)
    return found.select("doc_id", "held_out", "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidewell.llm.toxicity import fit, score

    documents = table(spark, sf_dir, "documents").select("doc_id", "text").withColumn("held_out", fold_of("doc_id", 5) == 0)
    labels = table(spark, sf_dir, "labels").select("doc_id", "toxic")
    model = fit(documents.where(~F.col("held_out")), labels.where(fold_of("doc_id", 5) != 0))
    found = score(documents, model, keep_text=False)
    return found.select("doc_id", "held_out", "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op10_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidewell.llm.jaccard_join import jaccard_components

    found = jaccard_components(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", "n_shingles", "component_id")


def op2_license_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document is the file source/lang/doc_id of a tree."""
    from tidewell.llm.license_scan import scan

    documents = table(spark, sf_dir, "documents").select("doc_id", "text", F.concat_ws("/", "source", "lang", F.col("doc_id").cast("string")).alias("path"))
    return scan(documents, keep_text=False).select("doc_id", "path", "own_license", "own_score", "header", "is_license_file", "license", "inherited_from")


def op11_pareto_layers(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidewell.llm.pareto_layers import layered_offers, offers

    made = offers(*[table(spark, sf_dir, name) for name in ("sale_lines", "sales", "items")])
    return layered_offers(made)


def op12_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidewell.llm.pii import find_pii

    found = find_pii(table(spark, sf_dir, "documents").select("doc_id", "text"), keep_text=False)
    return found.select("doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans")


def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidewell.llm.periodic_runs import find_runs

    found = find_runs(table(spark, sf_dir, "documents").select("doc_id", "text"), alter=True, keep_text=False)
    return found.select("doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256")


def queries() -> dict[str, Query]:
    return {name: f for name, f in globals().items() if name.startswith("op") and callable(f)}


def _rules_sql() -> str:
    """op3 in SQL: the measures word by word, then the rows of the threshold table."""
    from tidewell.llm.quality_rules import RULES, STOP_WORDS

    word, gap = r"[^\x20\x09-\x0D]+", r"[^\x20\x09-\x0D]"
    ratio = {
        "mean_word_chars": "word_chars / n_words",
        "symbol_ratio": "n_symbols / n_words",
        "shout_ratio": "n_shouts / n_words",
        "upper_ratio": "n_upper / n_letters",
        "stop_ratio": "n_stops / n_words",
        "dup_line_ratio": "n_dup_lines / n_lines",
    }
    fails = []
    for rule in RULES:
        a, b = ratio[rule.measure].split(" / ")
        value = f"(CASE WHEN {b} > 0 THEN CAST({a} AS DOUBLE) / {b} ELSE 0 END)"
        fails += [f"{value} < {rule.least}"] if rule.least is not None else []
        fails += [f"{value} > {rule.most}"] if rule.most is not None else []
    return f"""
    WITH d AS (SELECT ROW_NUMBER() OVER () AS r, doc_id, COALESCE(text, '') AS t FROM documents),
    w AS (SELECT r, doc_id, t, regexp_extract_all(t, '{word}') AS w, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '{gap}')) AS l FROM d),
    g AS (SELECT r, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS g FROM (SELECT r, w, UNNEST(range(1, len(w) - 1)) AS i FROM w) x),
    c AS (SELECT r, i, COUNT(*) OVER (PARTITION BY r, g) AS n FROM g),
    p AS (SELECT r, COUNT(DISTINCT p) AS n FROM (SELECT r, UNNEST([i, i + 1, i + 2]) AS p FROM c WHERE n > 1) y GROUP BY r),
    m AS (SELECT w.r, doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(LENGTH(array_to_string(w, '')) AS BIGINT) AS word_chars, CAST(len(regexp_extract_all(t, '[#*$%&|<>]')) AS BIGINT) AS n_symbols,
        CAST(len(l) - len(list_distinct(l)) AS BIGINT) AS n_dup_lines, CAST(COALESCE(p.n, 0) AS BIGINT) AS n_repeat_words, len(l) AS n_lines, len(regexp_extract_all(t, '!')) AS n_shouts,
        len(regexp_extract_all(t, '\\p{{Lu}}')) AS n_upper, len(regexp_extract_all(t, '\\p{{L}}')) AS n_letters,
        len(list_filter(w, lambda x: regexp_matches(x, '^(?i:{"|".join(sorted(STOP_WORDS))})(?:$|[,.;:!?])'))) AS n_stops
      FROM w LEFT JOIN p ON p.r = w.r),
    b AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM m)
    SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND NOT ({" OR ".join(fails)}) AS kept FROM b"""


_DEDUP_SQL = """
    WITH n AS (SELECT doc_id, translate(COALESCE(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
    g AS (SELECT t, MAX(doc_id) AS keep_id, COUNT(*) AS group_size FROM n GROUP BY t)
    SELECT n.doc_id, g.keep_id, g.group_size, n.doc_id = g.keep_id AS kept, sha256(n.t) AS text_sha256 FROM n JOIN g ON g.t = n.t"""


_JACCARD_SQL = r"""
    WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(COALESCE(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
    s AS (SELECT DISTINCT doc_id, UNNEST(CASE WHEN len(w) >= 3 THEN list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]) WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS g FROM w),
    n AS (SELECT doc_id, COUNT(*) AS n FROM s GROUP BY doc_id),
    shared AS (SELECT a.doc_id AS a, b.doc_id AS b, COUNT(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2),
    links AS (SELECT a, b FROM shared JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 90 * (x.n + y.n - c)),
    hop AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
    reach AS (SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT reach.a, hop.b FROM reach JOIN hop ON hop.a = reach.b)
    SELECT d.doc_id, CAST(COALESCE(n.n, 0) AS BIGINT) AS n_shingles, c.component_id
    FROM documents d LEFT JOIN n ON n.doc_id = d.doc_id JOIN (SELECT a, MIN(b) AS component_id FROM reach GROUP BY a) c ON c.a = d.doc_id"""


def _peeled_sql(name: str, of_types: bool) -> str:
    """Tables that peel twelve layers of the table ``name`` (ty?, p, d, w, q; less is better) one after the other."""
    same = "a.ty IS NOT DISTINCT FROM b.ty AND " if of_types else ""
    tables, rest = [], name
    for k in range(1, 13):
        tables.append(f"""{name}{k} AS MATERIALIZED (SELECT * FROM {rest} b WHERE NOT EXISTS (SELECT 1 FROM {rest} a
      WHERE {same}a.p <= b.p AND a.d <= b.d AND a.w <= b.w AND a.q <= b.q AND (a.p < b.p OR a.d < b.d OR a.w < b.w OR a.q < b.q)))""")
        tables.append(f"{name}_behind{k} AS MATERIALIZED (SELECT * FROM {rest} EXCEPT SELECT * FROM {name}{k})")
        rest = f"{name}_behind{k}"
    every = " UNION ALL ".join(f"SELECT *, {k} AS layer FROM {name}{k}" for k in range(1, 13))
    return ",\n    ".join([*tables, f"{name}_layers AS ({every})"])


def _offers_sql() -> str:
    """op11 in SQL: offers from lines, then layer after layer by comparing all that is left with all that is left."""
    best = "-4611686018427387904"
    codes = f"COALESCE(price, {best}) AS p, COALESCE(-discount, {best}) AS d, COALESCE(delay, {best}) AS w, COALESCE(-quantity, {best}) AS q"
    return f"""
    WITH l AS (SELECT s.item_id, s.vendor_id, CAST(s.quantity AS BIGINT) AS q, CAST(floor(100 * s.amount + 0.5) AS BIGINT) AS c, CAST(floor(100 * s.discount + 0.5) AS BIGINT) AS d,
        date_diff('day', CAST(o.sold_at AS DATE), CAST(s.shipped_at AS DATE)) AS days, i.brand, CAST(floor(100 * i.price + 0.5) AS BIGINT) AS p
      FROM sale_lines s LEFT JOIN sales o ON o.sale_id = s.sale_id LEFT JOIN items i ON i.item_id = s.item_id WHERE s.item_id IS NOT NULL AND s.vendor_id IS NOT NULL),
    g AS (SELECT item_id, vendor_id, MAX(brand) AS part_type, MAX(p) AS p, CAST(SUM(c * (100 - d)) FILTER (WHERE q IS NOT NULL) AS HUGEINT) AS paid,
        CAST(SUM(q) FILTER (WHERE c IS NOT NULL AND d IS NOT NULL) AS HUGEINT) AS pieces, CAST(SUM(d) AS HUGEINT) AS ds, COUNT(d) AS dn, CAST(SUM(days) AS HUGEINT) AS ts, COUNT(days) AS tn, MAX(q) AS quantity
      FROM l GROUP BY item_id, vendor_id),
    o AS (SELECT item_id, vendor_id, part_type, CASE WHEN p >= 1 THEN CAST(paid // (p * pieces) AS BIGINT) END AS price, CAST(ds // dn AS BIGINT) AS discount,
        CAST((ts - ((ts % tn) + tn) % tn) // tn AS BIGINT) AS delay, quantity FROM g),
    coded AS MATERIALIZED (SELECT *, {codes} FROM o),
    own AS MATERIALIZED (SELECT DISTINCT part_type AS ty, p, d, w, q FROM coded),
    every AS MATERIALIZED (SELECT DISTINCT p, d, w, q FROM coded),
    {_peeled_sql("own", True)},
    {_peeled_sql("every", False)},
    n AS (SELECT p, d, w, q, COUNT(*) AS n_equal FROM coded GROUP BY ALL)
    SELECT c.item_id, c.vendor_id, c.part_type, c.price, c.discount, c.delay, c.quantity, CAST(COALESCE(t.layer, 0) AS BIGINT) AS type_layer, CAST(COALESCE(e.layer, 0) AS BIGINT) AS global_layer, n.n_equal
    FROM coded c JOIN n ON (n.p, n.d, n.w, n.q) = (c.p, c.d, c.w, c.q) LEFT JOIN every_layers e ON (e.p, e.d, e.w, e.q) = (c.p, c.d, c.w, c.q)
      LEFT JOIN own_layers t ON t.ty IS NOT DISTINCT FROM c.part_type AND (t.p, t.d, t.w, t.q) = (c.p, c.d, c.w, c.q)"""


def oracle_sql() -> dict[str, str]:
    return {"op11_pareto_layers": _offers_sql(), "op3_quality_rules": _rules_sql(), "op4_exact_dedup": _DEDUP_SQL, "op10_jaccard_join": _JACCARD_SQL}

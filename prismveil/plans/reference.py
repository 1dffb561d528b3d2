"""Queries over the operators for detection, tokens, audit chains and rollups, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from prismveil.functions.categories import registry, token_columns
from prismveil.operators import attestation, audit_chain, compliance, context_risk, detection, evaluation, tokenisation
from prismveil.plans.storage import materialise, table
from prismveil.streaming.desanitizer import desanitize_chunks

KEY = b"an example key of thirty-two byte"
ALL_ON = {s: True for _, s, _, _ in detection.P.BUILTIN}


def _messages(spark: SparkSession, sf: str) -> DataFrame:
    """The messages, a re-sent one once."""
    return table(spark, sf, "messages").select("conv_id", "turn", "role", "content").distinct()


def _entries(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "audit_chain_py")


# ---- detection -----------------------------------------------------------------------------


def detect_counts(spark: SparkSession, sf: str) -> DataFrame:
    """Matches of the natively countable categories in each message."""
    c = F.col("content")
    return _messages(spark, sf).select("conv_id", "turn", *[detection.count_matches(c, n).alias(n.lower()) for n in detection.NATIVE])


def detect_spans(spark: SparkSession, sf: str) -> DataFrame:
    """Spans of the default categories in the messages."""
    return detection.detections(_messages(spark, sf), ["conv_id", "turn"], "content")


def detect_spans_all(spark: SparkSession, sf: str) -> DataFrame:
    """Spans of all categories, those that are off by default too."""
    return detection.detections(_messages(spark, sf), ["conv_id", "turn"], "content", detection.Engine(config=detection.Config(switches=ALL_ON)))


def detect_spans_german(spark: SparkSession, sf: str) -> DataFrame:
    """Spans with the German patterns and a custom one ahead of the built-in ones."""
    config = detection.Config(locale="de", custom=(("TICKET", r"#\d{7}\b"),))
    return detection.detections(_messages(spark, sf), ["conv_id", "turn"], "content", detection.Engine(config=config))


def detect_rollup(spark: SparkSession, sf: str) -> DataFrame:
    """Spans by role and category with all subtotals."""
    found = detection.detections(_messages(spark, sf), ["conv_id", "turn", "role"], "content")
    return found.cube("role", "category").agg(F.count(F.lit(1)).alias("n"), F.grouping_id().alias("level"))


def redact_email(spark: SparkSession, sf: str) -> DataFrame:
    """The messages without e-mail addresses."""
    return _messages(spark, sf).select("conv_id", "turn", detection.redact_matches(F.col("content"), "EMAIL", "<EMAIL>").alias("content"))


def card_luhn(spark: SparkSession, sf: str) -> DataFrame:
    """Mod-10 verdict on sixteen digits made from each order."""
    number = F.concat(F.lit("4"), F.lpad(((F.col("o_orderkey") * 7919 + F.col("o_custkey") * 104729) % 1_000_000_000_000_000).cast("string"), 15, "0"))
    return table(spark, sf, "orders").select("o_orderkey", number.alias("number"), detection.luhn_valid(number).alias("valid"))


def category_registry(spark: SparkSession, sf: str) -> DataFrame:
    """The built-in categories."""
    return registry(spark)


# ---- tokens --------------------------------------------------------------------------------


def _email_spans(spark: SparkSession, sf: str) -> DataFrame:
    rows = _messages(spark, sf).select("conv_id", "turn", F.posexplode(detection.matches(F.col("content"), "EMAIL")).alias("start", "text"))
    return rows.withColumn("category", F.lit("EMAIL"))


def token_numbering(spark: SparkSession, sf: str) -> DataFrame:
    """Tokens of the e-mail addresses of each conversation: texts forward, spans backward."""
    return tokenisation.number_tokens(_email_spans(spark, sf), ["conv_id"], [F.col("turn"), -F.col("start")])


def conversation_tokens(spark: SparkSession, sf: str) -> DataFrame:
    """The token table of whole conversations, all default categories."""
    return tokenisation.sanitize_scoped(_messages(spark, sf), ["conv_id", "turn"], ["conv_id"], ["turn"], "content")[1]


def conversation_sanitized(spark: SparkSession, sf: str) -> DataFrame:
    """The messages with tokens shared in their conversation."""
    return tokenisation.sanitize_scoped(_messages(spark, sf), ["conv_id", "turn"], ["conv_id"], ["turn"], "content")[0]


def tokenize_round_trip(spark: SparkSession, sf: str) -> DataFrame:
    """Every message in tokens and restored: what went in."""
    s = tokenisation.sanitize(_messages(spark, sf), "content")
    return tokenisation.desanitize(s, "sanitized", "tokens").select("conv_id", "turn", F.col("restored").alias("content"))


def redact_all(spark: SparkSession, sf: str) -> DataFrame:
    """The messages redacted: no numbers, no map."""
    return tokenisation.sanitize(_messages(spark, sf), "content", mode="redact").select("conv_id", "turn", "sanitized")


def entity_hashes(spark: SparkSession, sf: str) -> DataFrame:
    """Keyed hash of each e-mail address."""
    return _email_spans(spark, sf).select("conv_id", "turn", F.col("start").alias("ordinal"), tokenisation.entity_hash(KEY, F.col("category"), F.col("text")).alias("entity_hash"))


def zip_areas(spark: SparkSession, sf: str) -> DataFrame:
    """Three-digit areas of ZIP codes made from each customer."""
    code = F.lpad(((F.col("c_custkey") * 7919) % 100_000).cast("string"), 5, "0")
    return table(spark, sf, "customer").select("c_custkey", code.alias("zip"), tokenisation.zip3(code).alias("area"))


def generalized_values(spark: SparkSession, sf: str) -> DataFrame:
    """Dates and ages of orders in their safe form."""
    d, a = F.concat(F.lit("on "), F.date_format("o_orderdate", "MM/dd/yyyy")), F.concat(F.lit("aged "), (F.col("o_orderkey") % 30 + 90).cast("string"), F.lit(" years"))
    return table(spark, sf, "orders").select("o_orderkey", tokenisation.generalized_date(d).alias("year"), tokenisation.generalized_age(a).alias("age"))


def token_predicates(spark: SparkSession, sf: str) -> DataFrame:
    """Parts of everything in square brackets in the messages."""
    rows = _messages(spark, sf).select("conv_id", "turn", F.posexplode(F.coalesce(F.regexp_extract_all("content", F.lit(r"\[[^\[\]]*\]"), F.lit(0)), F.array().cast("array<string>"))).alias("ordinal", "token"))
    return rows.select("conv_id", "turn", "ordinal", "token", *[c.alias(n) for n, c in token_columns(F.col("token")).items()])


def escaped_tokens(spark: SparkSession, sf: str) -> DataFrame:
    """The messages with the tokens that stand in them escaped."""
    return _messages(spark, sf).select("conv_id", "turn", tokenisation.escape_tokens(F.col("content")).alias("content"))


def context_density(spark: SparkSession, sf: str) -> DataFrame:
    """Tokens per word of each message."""
    return _messages(spark, sf).select("conv_id", "turn", context_risk.token_density(F.col("content")).alias("density"))


def context_risks(spark: SparkSession, sf: str) -> DataFrame:
    """The risk of each message in tokens."""
    s = tokenisation.sanitize(_messages(spark, sf), "content").select("conv_id", "turn", "sanitized")
    return context_risk.with_risk(s, "sanitized").select("conv_id", "turn", "risk.*")


def stream_round_trip(spark: SparkSession, sf: str) -> DataFrame:
    """Every message in tokens, cut into chunks of seven characters, restored as a stream."""
    m = _messages(spark, sf).filter(F.col("content").isNotNull())
    s = materialise(tokenisation.sanitize(m, "content").select(F.concat_ws("-", "conv_id", "turn").alias("stream_id"), "conv_id", "turn", "sanitized", "tokens"), "stream-in")
    n = F.greatest(F.lit(1), F.ceil(F.length("sanitized") / 7)).cast("int")
    chunks = s.select("stream_id", F.posexplode(F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.expr("sanitized").substr(i * 7 + 1, F.lit(7)))).alias("seq", "delta"))
    tokens = s.select("stream_id", F.explode("tokens").alias("token", "value"))
    out = desanitize_chunks(chunks, tokens)
    texts = out.groupBy("stream_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("seq", "text"))), lambda x: x["text"]), "").alias("content"))
    return texts.select(F.split("stream_id", "-")[0].cast("bigint").alias("conv_id"), F.split("stream_id", "-")[1].cast("bigint").alias("turn"), "content")


# ---- audit chains --------------------------------------------------------------------------


def chain_build(spark: SparkSession, sf: str) -> DataFrame:
    """A hash chain over the events of each user."""
    e = table(spark, sf, "events").withColumn("payload", F.concat_ws("|", F.col("event_id").cast("string"), "event_type"))
    return audit_chain.build(e, "user_id", ["event_id"], "payload").select("user_id", "seq", "entry_hash")


def chain_broken_links(spark: SparkSession, sf: str) -> DataFrame:
    """Entries of audit_chain_py, as first delivered, that do not name the hash before them."""
    e = _entries(spark, sf)
    first = e.groupBy("chain_id", "seq", "event_id").agg(F.min_by(F.struct("prev_hash", "entry_hash"), F.struct("delivery_no", "received_at", "entry_hash")).alias("f")).select("chain_id", "seq", "event_id", "f.*")
    return audit_chain.broken_links(first, "chain_id", ["seq", "event_id"])


def audit_stats(spark: SparkSession, sf: str) -> DataFrame:
    return audit_chain.stats(_entries(spark, sf))


def audit_category_totals(spark: SparkSession, sf: str) -> DataFrame:
    return audit_chain.category_totals(_entries(spark, sf), "event_type")


def audit_checkpoints(spark: SparkSession, sf: str) -> DataFrame:
    return audit_chain.due_checkpoints(_entries(spark, sf), 100).select("chain_id", "seq", "event_id", "delivery_no").distinct()


def audit_violations(spark: SparkSession, sf: str) -> DataFrame:
    rows = audit_chain.schema_violations(_entries(spark, sf)).select(F.explode("violations").alias("violation"))
    return rows.groupBy("violation").agg(F.count(F.lit(1)).alias("n"))


def audit_overview(spark: SparkSession, sf: str) -> DataFrame:
    return compliance.overview(_entries(spark, sf))


def article_rollup(spark: SparkSession, sf: str) -> DataFrame:
    return compliance.per_article(_entries(spark, sf))


def article_rollup_bias(spark: SparkSession, sf: str) -> DataFrame:
    return compliance.per_article(table(spark, sf, "audit_chain_bias_py"))


def article_categories(spark: SparkSession, sf: str) -> DataFrame:
    return compliance.per_article_categories(_entries(spark, sf))


def article_period(spark: SparkSession, sf: str) -> DataFrame:
    """Evidence per article in a period and scope; a date as its end leaves that day out."""
    return compliance.per_article(compliance.scoped(_entries(spark, sf), "2025-02-10", "2025-03-04", ["AIA-12", "AIA-50"])).select("article", "evidence_count", "decision_count")


def decision_rollup(spark: SparkSession, sf: str) -> DataFrame:
    return compliance.per_decision(_entries(spark, sf))


def content_rollup(spark: SparkSession, sf: str) -> DataFrame:
    return compliance.content_modalities(_entries(spark, sf))


def attestation_rollup(spark: SparkSession, sf: str) -> DataFrame:
    return compliance.attestation_counts(_entries(spark, sf))


def key_window_rollup(spark: SparkSession, sf: str) -> DataFrame:
    return compliance.key_windows(_entries(spark, sf), table(spark, sf, "key_manifests"))


def revocation_rollup(spark: SparkSession, sf: str) -> DataFrame:
    """Certificates per key that is taken as revoked when its manifest ends."""
    revoked = table(spark, sf, "key_manifests").filter("valid_until is not null").select("key_id", F.col("valid_until").alias("revoked_at"))
    return compliance.revocations(_entries(spark, sf), revoked)


def merkle_by_delivery(spark: SparkSession, sf: str) -> DataFrame:
    """Merkle root over the entry hashes of each delivery, in order of time and hash."""
    return attestation.merkle_roots(_entries(spark, sf).filter("entry_hash is not null"), "delivery_no", "received_at", "entry_hash")


def span_overlaps(spark: SparkSession, sf: str) -> DataFrame:
    """Entity spans of each entry against the same spans moved by a third of their length."""
    rows = _entries(spark, sf).select("event_id", F.explode("entity_details").alias("d")).select("event_id", F.col("d.category").alias("category"), F.col("d.start").alias("start"), F.col("d.end").alias("end")).distinct()
    moved = rows.withColumn("by", F.floor((F.col("end") - F.col("start")) / 3).cast("int")).select("event_id", "category", (F.col("start") + F.col("by")).alias("start"), (F.col("end") + F.col("by")).alias("end"))
    return evaluation.span_pairs(rows, moved, ["event_id"])


def span_scores(spark: SparkSession, sf: str) -> DataFrame:
    """Precision and recall of the native e-mail spans against those of the engine."""
    m = _messages(spark, sf).filter("content is not null").withColumn("id", F.concat_ws("-", "conv_id", "turn"))
    found = detection.detections(m, ["id"], "content").select("id", "category", "start", "end")
    return evaluation.scores(found.filter("category = 'EMAIL'"), found, "id")


QUERIES = {
    f.__name__: f
    for f in (
        detect_counts, detect_spans, detect_spans_all, detect_spans_german, detect_rollup, redact_email, card_luhn, category_registry,
        token_numbering, conversation_tokens, conversation_sanitized, tokenize_round_trip, redact_all, entity_hashes, zip_areas, generalized_values, token_predicates, escaped_tokens,
        context_density, context_risks, stream_round_trip,
        chain_build, chain_broken_links, audit_stats, audit_category_totals, audit_checkpoints, audit_violations, audit_overview,
        article_rollup, article_rollup_bias, article_categories, article_period, decision_rollup, content_rollup, attestation_rollup, key_window_rollup, revocation_rollup, merkle_by_delivery, span_overlaps, span_scores,
    )
}

_M = "(SELECT DISTINCT conv_id, turn, role, content FROM messages)"
_OCTET = "(?:25[0-5]|2[0-4][0-9]|[01]?[0-9][0-9]?)"
_RE = {
    "email": r"\b[a-zA-Z0-9._%+\-]+@[a-zA-Z0-9.\-]+\.[a-zA-Z]{2,}\b",
    "ipv4": rf"\b(?:{_OCTET}\.){{3}}{_OCTET}\b",
    "iban": r"\b[A-Z]{2}[0-9]{2}(?:\s?[0-9A-Z]{4}){2,7}(?:\s?[0-9A-Z]{1,4})?\b",
    "api_key": r"\b(?:sk|pk|api|key|token|secret|bearer)[-_]?[a-zA-Z0-9_-]{20,512}\b",
    "aws_key": r"\b(?:AKIA|ASIA)[A-Z0-9]{16}\b",
    "jwt": r"\beyJ[a-zA-Z0-9_-]{10,}\.eyJ[a-zA-Z0-9_-]{10,}\.[a-zA-Z0-9_-]{10,}\b",
}
_EMAILS = f"""(SELECT conv_id, turn, unnest(m) AS text, unnest(range(len(m))) AS start FROM (
    SELECT conv_id, turn, regexp_extract_all(content, '{_RE["email"]}') AS m FROM {_M} WHERE content IS NOT NULL))"""
_ARTICLES = """
    SELECT article, count(*) AS evidence_count, count(DISTINCT nullif(decision_id, '')) AS decision_count,
        count(*) FILTER (WHERE event_type = 'bias_session_start') AS bias_sessions, count(*) FILTER (WHERE event_type = 'bias_finding') AS bias_findings,
        count(*) FILTER (WHERE event_type = 'bias_session_end') AS bias_ends, count(*) FILTER (WHERE event_type = 'bias_session_end' AND bias_context.wipe_confirmed) AS bias_wiped,
        count(*) FILTER (WHERE made) AS content_generated, count(*) FILTER (WHERE made AND content_context.labeled) AS content_labeled,
        count(*) FILTER (WHERE made AND content_context.deepfake) AS content_deepfake, coalesce(bool_or(pii_in_log), false) AS pii_in_log,
        CASE WHEN bias_ends = 0 THEN 0 ELSE CAST((10000 * bias_wiped + bias_ends // 2) // bias_ends AS DOUBLE) / 100 END AS wipe_pct,
        CASE WHEN content_generated = 0 THEN 0 ELSE CAST((10000 * content_labeled + content_generated // 2) // content_generated AS DOUBLE) / 100 END AS label_pct
    FROM (SELECT *, unnest(article_ref) AS article, event_type = 'content_generation' AND coalesce(content_context.synthetic, false) AS made FROM {table})
    WHERE article IS NOT NULL GROUP BY article"""
_PADDED = KEY.ljust(64, b"\0")
_I, _O = ("".join(f"\\x{b ^ x:02X}" for b in _PADDED) for x in (0x36, 0x5C))

ORACLES = {
    "detect_counts": f"SELECT conv_id, turn, {', '.join(f'coalesce(len(regexp_extract_all(content, $${r}$$)), 0) AS {n}' for n, r in _RE.items())} FROM {_M}",
    "redact_email": f"SELECT conv_id, turn, regexp_replace(content, '{_RE['email']}', '<EMAIL>', 'g') AS content FROM {_M}",
    "card_luhn": """
        SELECT o_orderkey, number, list_sum(list_transform(range(1, 17), lambda i: CASE WHEN i % 2 = 0 THEN CAST(number[i] AS INT)
               WHEN CAST(number[i] AS INT) * 2 > 9 THEN CAST(number[i] AS INT) * 2 - 9 ELSE CAST(number[i] AS INT) * 2 END)) % 10 = 0 AS valid
        FROM (SELECT o_orderkey, '4' || lpad(CAST((o_orderkey * 7919 + o_custkey * 104729) % 1000000000000000 AS VARCHAR), 15, '0') AS number FROM orders)""",
    "token_numbering": f"""
        WITH seen AS (SELECT conv_id, trim(text) AS value, min((turn, -start)) AS pos FROM {_EMAILS} GROUP BY conv_id, trim(text)),
        numbered AS (SELECT conv_id, value, row_number() OVER (PARTITION BY conv_id ORDER BY pos) - 1 AS idx FROM seen)
        SELECT conv_id, value, 'EMAIL' AS category, idx, '[EMAIL_' || idx || ']' AS token FROM numbered""",
    "tokenize_round_trip": f"SELECT conv_id, turn, content FROM {_M}",
    "stream_round_trip": f"SELECT conv_id, turn, content FROM {_M} WHERE content IS NOT NULL",
    "entity_hashes": f"""
        SELECT conv_id, turn, CAST(start AS INTEGER) AS ordinal, sha256('{_O}'::BLOB || unhex(sha256('{_I}'::BLOB || encode('EMAIL:' || lower(trim(text)))))) AS entity_hash FROM {_EMAILS}""",
    "zip_areas": f"""
        SELECT c_custkey, zip, CASE WHEN zip[1:3] IN ({", ".join(f"'{z}'" for z in tokenisation.SMALL_ZIP3)}) THEN '000' ELSE zip[1:3] END || 'XX' AS area
        FROM (SELECT c_custkey, lpad(CAST((c_custkey * 7919) % 100000 AS VARCHAR), 5, '0') AS zip FROM customer)""",
    "generalized_values": "SELECT o_orderkey, strftime(o_orderdate, '%Y') AS year, 'aged 90+ years' AS age FROM orders",
    "token_predicates": f"""
        SELECT conv_id, turn, CAST(ordinal AS INTEGER) AS ordinal, token, ok AS is_token,
               CASE WHEN ok THEN regexp_extract(token, '^\\[([A-Z][A-Z0-9_]*)_([0-9]+|REDACTED)\\]$', 1) END AS category,
               CASE WHEN ok THEN regexp_extract(token, '^\\[([A-Z][A-Z0-9_]*)_([0-9]+|REDACTED)\\]$', 2) END AS suffix, ok AND suffix(token, '_REDACTED]') AS is_redacted
        FROM (SELECT *, length(token) <= 40 AND regexp_matches(token, '^\\[([A-Z][A-Z0-9_]*)_([0-9]+|REDACTED)\\]$') AS ok FROM (
          SELECT conv_id, turn, unnest(m) AS token, unnest(range(len(m))) AS ordinal FROM (
            SELECT conv_id, turn, regexp_extract_all(content, '\\[[^\\[\\]]*\\]') AS m FROM {_M} WHERE content IS NOT NULL)))""",
    "escaped_tokens": f"SELECT conv_id, turn, regexp_replace(content, '\\[([A-Z][A-Z0-9_]*_(?:[0-9]+|REDACTED))\\]', '［\\1］', 'g') AS content FROM {_M}",
    "context_density": f"""
        SELECT conv_id, turn, CASE WHEN content IS NULL OR regexp_matches(content, '^\\s*$') THEN 0.0 ELSE
          floor(CAST(len(regexp_extract_all(lower(content), '\\[[a-z][a-z0-9_]*_(?:[0-9]+|redacted)\\]')) AS DOUBLE) / len(regexp_split_to_array(lower(content), '\\s+')) * 1000 + 0.5) / 1000 END AS density
        FROM {_M}""",
    "chain_build": """
        WITH RECURSIVE e AS (SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS seq, concat_ws('|', CAST(event_id AS VARCHAR), event_type) AS p FROM events),
        c AS (SELECT user_id, seq, sha256(repeat('0', 64) || p) AS entry_hash FROM e WHERE seq = 0
              UNION ALL SELECT e.user_id, e.seq, sha256(c.entry_hash || e.p) FROM c JOIN e ON e.user_id = c.user_id AND e.seq = c.seq + 1)
        SELECT user_id, seq, entry_hash FROM c""",
    "chain_broken_links": """
        WITH first AS (SELECT chain_id, seq, event_id, prev_hash, entry_hash FROM (SELECT *, row_number() OVER (PARTITION BY chain_id, seq, event_id ORDER BY delivery_no, received_at, entry_hash) AS rn FROM audit_chain_py) WHERE rn = 1)
        SELECT chain_id, seq, event_id, expected, found FROM (
          SELECT chain_id, seq, event_id, lag(entry_hash, 1, repeat('0', 64)) OVER (PARTITION BY chain_id ORDER BY seq, event_id) AS expected, prev_hash AS found FROM first)
        WHERE expected IS DISTINCT FROM found""",
    "audit_stats": "SELECT count(*) AS total_events, CAST(sum(entity_count) AS BIGINT) AS total_entities, count(DISTINCT model) AS n_models, count(DISTINCT provider) AS n_providers, min(timestamp) AS first_timestamp, max(timestamp) AS last_timestamp FROM audit_chain_py",
    "audit_category_totals": """
        SELECT event_type, e.key AS category, CAST(sum(e.value) AS BIGINT) AS n FROM (SELECT event_type, unnest(map_entries(categories)) AS e FROM audit_chain_py)
        WHERE e.value IS NOT NULL GROUP BY event_type, e.key""",
    "audit_checkpoints": "SELECT DISTINCT chain_id, seq, event_id, delivery_no FROM audit_chain_py WHERE (seq + 1) % 100 = 0 AND coalesce(event_type, '') <> 'chain_checkpoint'",
    "audit_overview": """
        SELECT count(*) AS entries, count(compliance_version) AS compliance_entries, count(*) - count(compliance_version) AS other_entries, count(certificate_hash) AS certificates,
               min(timestamp) AS first_timestamp, max(timestamp) AS last_timestamp, coalesce(bool_or(pii_in_log), false) AS pii_in_log FROM audit_chain_py""",
    "article_rollup": _ARTICLES.format(table="audit_chain_py"),
    "article_rollup_bias": _ARTICLES.format(table="audit_chain_bias_py"),
    "article_categories": """
        SELECT article, e.key AS category, CAST(sum(e.value) AS BIGINT) AS n FROM (
          SELECT article, unnest(map_entries(categories)) AS e FROM (SELECT unnest(article_ref) AS article, categories FROM audit_chain_py))
        WHERE article IS NOT NULL AND e.value IS NOT NULL GROUP BY article, e.key""",
    "article_period": """
        SELECT article, count(*) AS evidence_count, count(DISTINCT nullif(decision_id, '')) AS decision_count FROM (
          SELECT unnest(article_ref) AS article, decision_id FROM audit_chain_py
          WHERE timestamp <> '' AND timestamp >= '2025-02-10' AND timestamp <= '2025-03-04' AND list_has_any(article_ref, ['AIA-12', 'AIA-50']))
        WHERE article IS NOT NULL GROUP BY article""",
    "decision_rollup": """
        SELECT decision_id, entry_count, coalesce(articles, '') AS articles, first_timestamp, last_timestamp FROM (
          SELECT decision_id, count(*) AS entry_count, min(timestamp) AS first_timestamp, max(timestamp) AS last_timestamp FROM audit_chain_py WHERE decision_id <> '' GROUP BY decision_id)
        LEFT JOIN (SELECT decision_id, string_agg(a, ',' ORDER BY a) AS articles FROM (
          SELECT DISTINCT decision_id, a FROM (SELECT decision_id, unnest(article_ref) AS a FROM audit_chain_py) WHERE a IS NOT NULL) GROUP BY decision_id) USING (decision_id)""",
    "content_rollup": """
        SELECT content_context.modality AS modality, count(*) AS generated, count(*) FILTER (WHERE content_context.labeled) AS labeled, count(*) FILTER (WHERE content_context.deepfake) AS deepfake
        FROM audit_chain_py WHERE event_type = 'content_generation' AND content_context.synthetic GROUP BY content_context.modality""",
    "attestation_rollup": "SELECT key_id, count(*) AS certificates, count(DISTINCT certificate_hash) AS distinct_certificates FROM audit_chain_py WHERE certificate_hash <> '' GROUP BY key_id",
    "revocation_rollup": """
        SELECT key_id, revoked_at, count(*) AS certificates, count(*) FILTER (WHERE timestamp >= revoked_at) AS after_revocation
        FROM audit_chain_py JOIN (SELECT key_id, min(valid_until) AS revoked_at FROM key_manifests WHERE valid_until IS NOT NULL GROUP BY key_id) USING (key_id)
        WHERE certificate_hash <> '' GROUP BY key_id, revoked_at""",
    "span_overlaps": """
        WITH r AS (SELECT DISTINCT event_id, d.category AS category, d.start AS s, d."end" AS e FROM (SELECT event_id, unnest(entity_details) AS d FROM audit_chain_py)),
        m AS (SELECT event_id, category, s + (e - s) // 3 AS s, e + (e - s) // 3 AS e FROM r)
        SELECT r.event_id AS event_id, r.category AS category, r.s AS f_start, r.e AS f_end, m.s AS t_start, m.e AS t_end FROM r JOIN m USING (event_id, category)
        WHERE least(r.e, m.e) - greatest(r.s, m.s) > 0 AND least(r.e, m.e) - greatest(r.s, m.s) >= 0.5 * least(r.e - r.s, m.e - m.s)""",
}

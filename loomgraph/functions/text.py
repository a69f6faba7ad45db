"""Text functions as Column expressions: tokens, keywords, labels, importance, ids."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Stop words of the token index and of keyword extraction, token patterns and trim sets.
INDEX_STOP_WORDS = """a about above after again all am an and any are aren't as at be because been before being below between
both but by can cannot could did do does doing down during each few for from further had has have having he her here hers
herself him himself his how i if in into is isn't it its itself let's me more most my myself no nor not of off on once only
or other ought our ours ourselves out over own same she should so some such than that the their theirs them themselves then
there these they this those through to too under until up very was wasn't we were weren't what when where which while who
whom why with won't would you your yours yourself yourselves""".split()
KEYWORD_STOP_WORDS = """a an the in on at to for of with by from up about into over after and or but so is are was were be
been being have has had do does did this that these those it its we they them their our ours""".split()
INDEX_TOKEN = r"[a-zA-Z0-9_\-.:]{2,}"
INDEX_TRIM = ".,:;()[]\"'_-"
KEYWORD_TOKEN = r"[a-zA-Z0-9_\-.:]{3,}"
KEYWORD_TRIM = ".,:;()[]\"'{}<>/\\|`=-_"
INSTANCE_SUFFIX = r"([_\-][0-9]+)+$"
NUMBER_WITH_UNIT = r"^[0-9.:]+[a-z]{1,4}$"
HEX_DIGEST = r"^[0-9a-f]*[0-9][0-9a-f]*$"
LOG_TIMESTAMP = r"^[\[(]?[0-9]{2,4}[-/:.][0-9\-/:.TZ+]*(?:[ T][0-9]{2}:[0-9]{2}[0-9:.,Z+\-]*)?[\])]?\s+"
# Words that tell the kind of a log line, in order of precedence.
INCIDENT = "error|fail|drop|fatal|timeout|panic"
TELEMETRY = "temp|fan|pwm|rpm|packet|parquet|crc|telemetry|="
PROCEDURE = "start|init|connect|complete|schema|finish"


def tokens(text: Column) -> Column:
    """Distinct index tokens in the order of their first occurrence; an empty array for null."""
    found = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(INDEX_TOKEN), F.lit(0))
    clean = F.transform(found, lambda x: F.lower(F.btrim(x, F.lit(INDEX_TRIM))))
    return F.array_distinct(F.filter(clean, lambda x: (F.length(x) >= 2) & ~x.isin(INDEX_STOP_WORDS)))


def is_noise(token: Column) -> Column:
    """Values rather than words: fewer than three letters, a number with a unit, or a digest."""
    return (F.length(F.regexp_replace(token, "[^a-z]", "")) < 3) | token.rlike(NUMBER_WITH_UNIT) | token.rlike(HEX_DIGEST)


def keyword_tokens(text: Column) -> Column:
    """All keyword tokens with repetitions, in order: cleaned, instance numbers folded, stop words and values left out."""
    found = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(KEYWORD_TOKEN), F.lit(0))
    clean = F.transform(found, lambda x: F.regexp_replace(F.lower(F.btrim(x, F.lit(KEYWORD_TRIM))), INSTANCE_SUFFIX, ""))
    return F.filter(clean, lambda x: (F.length(x) >= 3) & ~x.isin(KEYWORD_STOP_WORDS) & ~is_noise(x))


def keyword_limit(n_bytes: Column) -> Column:
    return F.when(n_bytes <= 200, 8).otherwise(F.least(F.lit(80), (8 + F.floor(F.sqrt(n_bytes.cast("double")) * 0.4)).cast("int"))).cast("int")


def truncated(text: Column, most: int) -> Column:
    """At most ``most`` bytes as they are; longer texts are cut after as many characters, with dots."""
    return F.when(F.octet_length(text) <= most, text).otherwise(F.concat(F.substring(text, 1, most), F.lit("...")))


def without_timestamp(line: Column) -> Column:
    rest = F.trim(F.regexp_replace(line, LOG_TIMESTAMP, ""))
    return F.when(rest != "", rest).otherwise(line)


def event_label(line: Column) -> Column:
    return truncated(without_timestamp(line), 48)


def line_kind(line: Column) -> Column:
    low = F.lower(line)
    return F.when(low.rlike(INCIDENT), "incident").when(low.rlike(TELEMETRY), "telemetry").when(low.rlike(PROCEDURE), "procedure").otherwise("episodic_event")


def normal_anchor(tag: Column) -> Column:
    """Lower-cased and trimmed with a leading #; '' for blank tags and a lone #."""
    clean = F.lower(F.trim(F.coalesce(tag, F.lit(""))))
    return F.when(clean.isin("", "#"), "").when(clean.startswith("#"), clean).otherwise(F.concat(F.lit("#"), clean))


def importance(kind: Column, label: Column, summary: Column, anchored: Column) -> Column:
    """Intrinsic importance by kind and wording, first rule that holds; anchored nodes get 0.15 more, 1 at most."""
    t, a, b = F.lower(F.trim(F.coalesce(kind, F.lit("")))), F.lower(F.coalesce(label, F.lit(""))), F.lower(F.coalesce(summary, F.lit("")))
    # Wordings and scores of the rules.
    rules = [
        (t.isin("system_config", "architecture_rule", "config", "rule") | a.rlike("config|architecture|api_key|ingest_port|network bounds") | b.rlike("system config|architecture rule"), 0.90),
        ((t == "task_goal") | a.contains("task goal"), 0.85),
        (t.isin("incident", "error_state") | a.rlike("error|fatal|incident"), 0.80),
        (t.isin("decision", "procedure", "candidate_action", "action") | a.rlike("decision|procedure|^step |^action:"), 0.75),
        (a.rlike("jitter|transient|noise|ephemeral|speculative|debug log") | b.rlike("transient|ephemeral|jitter"), 0.25),
        (t.isin("sensory_fact", "telemetry", "telemetry_chunk", "telemetry_rule") | a.rlike("telemetry|sensor") | b.contains("telemetry"), 0.45),
    ]
    score = F.lit(0.50)
    for rule, value in reversed(rules):
        score = F.when(rule, F.lit(value)).otherwise(score)
    return F.when(anchored, F.least(F.lit(1.0), score + 0.15)).otherwise(score)


def outcome(raw: Column) -> Column:
    low = F.lower(F.trim(F.coalesce(raw, F.lit(""))))
    return F.when(low.isin("success", "completed", "ok", "ready"), "success").when(low.isin("failure", "error", "failed"), "failure").otherwise("neutral")


def salience(raw: Column) -> Column:
    known = outcome(raw)
    return F.when(known == "success", 1.0).when(known == "failure", 0.1).otherwise(0.5)


def content_id(prefix: str, seed: Column) -> Column:
    """Prefix and hash of the content, sixteen characters in all."""
    return F.substring(F.concat(F.lit(prefix + "-"), F.sha2(seed, 256)), 1, 16)


def lexical_score(query: list[str], label: Column, summary: Column) -> Column:
    """Keyword match of a tokenised query with a label and a summary in [0, 1], four decimals."""
    a, b = F.lower(F.coalesce(label, F.lit(""))), F.lower(F.coalesce(summary, F.lit("")))
    in_a, in_b = tokens(a), tokens(b)
    if not query:
        return F.lit(0.0)
    got = sum((F.when(F.array_contains(in_a, q), 2.0).when(a.contains(q), 1.2).when(F.array_contains(in_b, q), 1.0).when(b.contains(q), 0.5).otherwise(0.0) for q in query), F.lit(0.0))
    ratio = F.least(F.lit(1.0), got / (2.0 * len(query)))
    phrase = " ".join(query)
    return F.round(F.when(a.contains(phrase), F.greatest(ratio, F.lit(0.95))).when(b.contains(phrase), F.greatest(ratio, F.lit(0.80))).otherwise(ratio), 4)

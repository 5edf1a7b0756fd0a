"""Rule-based risk extraction from announcements: title policy, rule hits with negation and exclusion, events and their windowed counts.

A rule has label, severity, keywords and expressions (see Rule). Texts are read once for all rules, and nothing is joined.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from riskweave.functions.text import event_key
from riskweave.functions.wording import CHINESE, TITLE_EXCLUSIONS, TITLE_OVERRIDES, Wording
from riskweave.operators.rule_scan import Scanner


@dataclass(frozen=True)
class Rule:
    rule_id: str
    label: str
    severity: int
    patterns: tuple[str, ...]
    exclusions: tuple[str, ...] = field(default=())
    keywords: tuple[str, ...] = field(default=())


def title_decision(title: Column, overrides=TITLE_OVERRIDES, exclusions=TITLE_EXCLUSIONS) -> Column:
    """status ('eligible', or 'excluded_by_title' if an exclusion's pattern is found and no override's), reason and pattern of the first
    (reason, pattern) that is found, empty for none. White space in titles and case are ignored."""
    bare = F.regexp_replace(F.coalesce(title, F.lit("")), r"\s+", "")
    out = F.when(F.lit(False), F.struct(F.lit("").alias("status"), F.lit("").alias("reason"), F.lit("").alias("pattern")))
    for status, rules in (("eligible", overrides), ("excluded_by_title", exclusions)):
        for reason, pattern in rules:
            out = out.when(bare.rlike("(?i)" + pattern), F.struct(F.lit(status).alias("status"), F.lit(reason).alias("reason"), F.lit(pattern).alias("pattern")))
    return out.otherwise(F.struct(F.lit("eligible").alias("status"), F.lit("").alias("reason"), F.lit("").alias("pattern")))


def title_policy(title: Column, overrides=TITLE_OVERRIDES, exclusions=TITLE_EXCLUSIONS) -> Column:
    """'analyze' or 'excluded_by_title'."""
    return F.when(title_decision(title, overrides, exclusions)["status"] == "eligible", "analyze").otherwise("excluded_by_title")


def newest(docs: DataFrame, most: int, status: str = "analysis_status") -> DataFrame:
    """Of each company's eligible announcements the newest ones."""
    own = Window.partitionBy("company").orderBy(F.desc("date"), F.desc("announcement_id"))
    kept = docs.where(~F.coalesce(F.col(status) == "excluded_by_title", F.lit(False)))
    return kept.withColumn("__n", F.row_number().over(own)).where(F.col("__n") <= most).drop("__n")


def rule_hits(docs: DataFrame, rules: list[Rule], negations: list[str], reach: int = 16, around: int = 200, wording: Wording | None = CHINESE, unicode: bool = False) -> DataFrame:
    """docs' keys with one row per rule that is found: the first place that is not suppressed, else the first place (of places with one start the longest first),
    whether it was suppressed, and why: a negation word within `reach` characters before it, an exclusion pattern within `around` characters,
    or a context in which it is no event (see Wording; None: contexts do not count). All rules are looked for in one pass (see rule_scan)."""
    scanner = Scanner(tuple(rules), tuple(negations), reach, around, wording, unicode)
    keys = [c for c in docs.columns if c not in ("text", "title")]
    schema = ", ".join([*[f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(*keys).schema.fields], "rule_id string, label string, severity int, start int, match string, suppressed boolean, reason string"])

    def run(batches):
        import pyarrow as pa

        for part in batches:
            rows, found = [], []
            for i, text in enumerate(part.column(part.num_columns - 1)):
                for hit in scanner.hits(text.as_py() or ""):
                    rows.append(i)
                    found.append(hit)
            own = [rules[h[0]] for h in found]
            made = [
                pa.array([r.rule_id for r in own], pa.string()), pa.array([r.label for r in own], pa.string()), pa.array([r.severity for r in own], pa.int32()), pa.array([h[1] for h in found], pa.int32()),
                pa.array([h[2] for h in found], pa.string()), pa.array([bool(h[3]) for h in found], pa.bool_()), pa.array([h[3] for h in found], pa.string()),
            ]
            taken = [c.take(pa.array(rows, pa.int64())) for c in part.columns[:-1]]
            yield pa.RecordBatch.from_arrays([*taken, *made], names=[*keys, "rule_id", "label", "severity", "start", "match", "suppressed", "reason"])

    return docs.select(*keys, "text").mapInArrow(run, schema)


def evidence(text: Column, start: Column, most: int = 240) -> Column:
    """The sentence around a place, of at most so many characters."""
    head = F.substring(text, F.lit(1), start - 1)
    begin = F.length(head) - F.length(F.regexp_replace(head, r"(?s)^.*[.!?。！？\n]", "")) + 1
    rest = F.substring(text, begin, F.lit(most))
    end = F.regexp_instr(F.substring(rest, start - begin + 1, F.lit(most)), F.lit(r"[.!?。！？\n]"))
    return F.trim(F.when(end > 0, F.substring(rest, F.lit(1), start - begin + end)).otherwise(rest))


def events(hits: DataFrame) -> DataFrame:
    """One row per announcement and label among the hits that stand: the first by rule and place."""
    own = Window.partitionBy("event_key").orderBy("rule_id", "start")
    keyed = hits.where(~F.col("suppressed")).withColumn("event_key", event_key(F.col("announcement_id").cast("string"), F.col("label")))
    return keyed.withColumn("__n", F.row_number().over(own)).where("__n = 1").drop("__n")


def rule_summary(hits: DataFrame) -> DataFrame:
    """By document and theme (a label's first letter), of the hits that stand: how many, their labels, the gravest severity."""
    kept = hits.where(~F.col("suppressed")).withColumn("theme", F.substring("label", 1, 1))
    return kept.groupBy("announcement_id", "theme").agg(F.count("*").alias("hits"), F.array_sort(F.collect_set("label")).alias("labels"), F.max("severity").alias("max_severity"))


def in_window(day: Column, as_of: Column, days: int, wider: bool = False) -> Column:
    """Whether a day is one of the `days` days up to as_of, that day included; `wider`: one more at the far end, as a local store has it."""
    age = F.datediff(as_of, day)
    return F.coalesce(age.between(0, days if wider else days - 1), F.lit(False))


def windowed_counts(docs: DataFrame, found: DataFrame, as_of: str, windows: tuple[int, ...] = (30, 60, 90)) -> DataFrame:
    """Announcements, those that are read, events and grave events (severity 4 and more) of each company in the days up to as_of, the
    severity in the longest window, and the share of events whose evidence holds (1 without any).

    Only events whose evidence holds count (column evidence_valid of found; without it all do)."""
    inside = lambda n: in_window(F.col("date"), F.lit(as_of).cast("date"), n)
    longest = max(windows)
    read = ~F.coalesce(F.col("analysis_status") == "excluded_by_title", F.lit(False)) if "analysis_status" in docs.columns else F.lit(True)
    counted = docs.groupBy("company").agg(
        *[F.count_if(inside(n)).alias(f"f1_announcements_{n}d") for n in windows], *[F.count_if(inside(n) & read).alias(f"f1_analyzed_{n}d") for n in windows]
    )
    valid = F.col("evidence_valid") if "evidence_valid" in found.columns else F.lit(True)
    risk = found.groupBy("company").agg(
        *[F.count_if(inside(n) & valid).alias(f"f1_events_{n}d") for n in windows],
        *[F.count_if(inside(n) & valid & (F.col("severity") >= 4)).alias(f"f1_high_events_{n}d") for n in windows],
        F.max(F.when(inside(longest) & valid, F.col("severity"))).alias("f1_max_severity"),
        F.round(F.avg(F.when(inside(longest) & valid, F.col("severity"))), 4).alias("f1_avg_severity"),
        F.round(F.avg(valid.cast("int")), 4).alias("f1_evidence_valid_ratio"),
    )
    return counted.join(risk, "company", "left").fillna(1.0, ["f1_evidence_valid_ratio"]).fillna(0)


def data_quality(docs: DataFrame) -> DataFrame:
    """By company: announcements, those read and left out by title, of those read the ones fetched, with text and not fetched, the share
    with text (null if none was fetched), and whether some were not fetched. docs: company, analysis_status, text_status."""
    read = ~F.coalesce(F.col("analysis_status") == "excluded_by_title", F.lit(False))
    fetched = read & ~F.coalesce(F.col("text_status") == "not_fetched", F.lit(False))
    parsed = read & F.coalesce(F.contains("text_status", F.lit("_parsed")), F.lit(False))
    counts = docs.groupBy("company").agg(F.count("*").alias("announcements"), *[F.count_if(x).alias(n) for n, x in (("eligible", read), ("excluded", ~read), ("fetched", fetched), ("parsed", parsed))])
    return counts.withColumns({
        "not_fetched": F.col("eligible") - F.col("fetched"), "not_fulltext": F.col("fetched") - F.col("parsed"),
        "parsed_ratio": F.round(F.try_divide("parsed", "fetched"), 4), "truncated": F.col("fetched") < F.col("eligible"),
    })


def model_candidates(docs: DataFrame, hits: DataFrame, signals: DataFrame, least: float) -> DataFrame:
    """Of docs those that a model should read: a rule has a hit that stands in them, or their signal (announcement_id, max_score) is high."""
    ruled = hits.where(~F.col("suppressed")).select("announcement_id")
    scored = signals.where(F.col("max_score") >= least).select("announcement_id")
    return docs.join(ruled.union(scored).distinct(), "announcement_id", "left_semi")


def label_counts(found: DataFrame, as_of: str, days: int = 90) -> DataFrame:
    """Events by company and label, in long form: labels depend on the data."""
    age = F.datediff(F.lit(as_of).cast("date"), F.col("date"))
    return found.where((age >= 0) & (age < days)).groupBy("company", "label").agg(F.count("*").alias("events"))


def theme_distribution(counts: DataFrame) -> DataFrame:
    """company, label, events with each label's share of its company's events."""
    return counts.where("events > 0").withColumn("share", F.col("events") / F.sum("events").over(Window.partitionBy("company")))


def window_comparison(counts: DataFrame, windows: tuple[int, ...] = (30, 60, 90)) -> DataFrame:
    """company, days, announcements, events and events per announcement (0 without any)."""
    rows = F.array(*[F.struct(F.lit(n).alias("days"), F.col(f"f1_announcements_{n}d").alias("announcements"), F.col(f"f1_events_{n}d").alias("events")) for n in windows])
    flat = counts.select("company", F.explode(rows).alias("w")).select("company", "w.*")
    return flat.withColumn("per_announcement", F.coalesce(F.try_divide("events", "announcements"), F.lit(0.0)))

"""Reports over findings: severity counts, status, ordered lists and the reader's view.

The severities and their names are parameters with the usual defaults, not rules of the library.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from statuta.functions.regulatory import snake_to_title

# Names of severities and kinds, and the advice shown for them.
SEVERITIES = ("critical", "high", "medium", "low")
SHOWN = {"critical": "critical", "high": "warning", "medium": "info", "low": "pass"}
COUNTED = {"critical": "critical", "high": "high-priority", "medium": "medium", "low": "low"}
KINDS = ("missing", "incorrect", "prohibited", "insufficient_disclosure")
ADVICE = {"missing": "Add the missing required element to the label.", "prohibited": "Remove or replace this prohibited claim."}
OTHER_ADVICE = "Review and correct the claim to meet CFR requirements."
MISSING, MISSING_MARK, DEFAULT_REGULATION = "missing_required_element", "[Missing element] ", "21 CFR Part 101"


def mapped(column: Column, mapping: dict[str, str], default: str | None = None) -> Column:
    """A literal lookup; values without an entry get ``default``."""
    found = F.lit(default)
    for key, value in mapping.items():
        found = F.when(column == key, value).otherwise(found)
    return found


def severity_order(column: Column, severities: tuple[str, ...] = SEVERITIES) -> Column:
    """The place of a severity; unknown and null ones come last."""
    place = F.lit(len(severities))
    for i, name in enumerate(severities):
        place = F.when(column == name, i).otherwise(place)
    return place


def severity_report(documents: DataFrame, findings: DataFrame, severities: tuple[str, ...] = SEVERITIES) -> DataFrame:
    """A row per document (document_id, error): total, count per severity, status and sorted findings.

    Unknown severities count in the total only. Status: error if there is an error and no finding;
    non_compliant from the two highest severities, partially_compliant from the others, else
    compliant. Documents without findings stay.
    """
    counts = [F.count_if(F.col("severity") == s).alias(s) for s in severities]
    items = F.struct(severity_order(F.col("severity"), severities).alias("place"), "seq", "severity", "text")
    grouped = findings.groupBy("document_id").agg(F.count("*").alias("total"), *counts, F.array_sort(F.collect_list(items)).alias("findings"))
    rows = documents.select("document_id", "error").join(grouped, "document_id", "left").fillna(0, ["total", *severities])
    grave, slight = (sum((F.col(s) for s in part), F.lit(0)) for part in (severities[:2], severities[2:]))
    status = F.when(F.col("error").isNotNull() & (F.col("total") == 0), "error").when(grave > 0, "non_compliant").when(slight > 0, "partially_compliant").otherwise("compliant")
    return rows.withColumn("overall_status", status)


def shown_status(status: Column) -> Column:
    """compliant and non_compliant stay; all else needs a review."""
    return F.when(status.isin("compliant", "non_compliant"), status).otherwise("needs_review")


def summary_line(name: Column, severities: tuple[str, ...] = SEVERITIES) -> Column:
    """``Found 2 potential issues in x.pdf: 1 critical, 1 low.`` from total and the severity counts."""
    parts = F.concat_ws(", ", *[F.when(F.col(s) > 0, F.concat(F.col(s).cast("string"), F.lit(f" {COUNTED.get(s, s)}"))) for s in severities])
    issues = F.concat(F.lit("Found "), F.col("total").cast("string"), F.lit(" potential issue"), F.when(F.col("total") > 1, "s").otherwise(""), F.lit(" in "), name, F.lit(": "), parts, F.lit("."))
    return F.when(F.col("total") == 0, F.concat(F.lit("No violations detected in "), name, F.lit("."))).otherwise(issues)


def finding_view(findings: DataFrame) -> DataFrame:
    """Reader's view of findings: a number per document, shown severity, category and title."""
    kind = F.when(F.col("violation_type").isin(*KINDS), snake_to_title(F.col("violation_type"))).otherwise("Potential Violation")
    category = snake_to_title(F.coalesce("claim_type", F.lit("claim")))
    element = F.replace(F.coalesce("claim_text", F.lit("Required Element")), F.lit(MISSING_MARK), F.lit(""))
    title = F.when(F.col("claim_type") == MISSING, element).otherwise(F.concat_ws(" ", kind, category))
    advice = mapped(F.col("violation_type"), ADVICE, OTHER_ADVICE)
    number = F.expr("row_number() over (partition by document_id order by seq)")
    return findings.select("document_id", F.concat(F.lit("v-"), number.cast("string")).alias("id"), mapped(F.col("severity"), SHOWN, "info").alias("severity"), category.alias("category"), title.alias("title"), advice.alias("recommendation"), F.coalesce("explanation", F.lit("")).alias("description"), F.coalesce("cfr_citation", F.lit(DEFAULT_REGULATION)).alias("regulation"))

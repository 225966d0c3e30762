"""Document analysis: claims of a document, the regulations nearest to them, and a report."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from statuta.functions import regulatory as R
from statuta.operators import reports, retrieval
from statuta.plans.providers import encode, overlap_score

TOP = 5
# Kinds of claim and words that show them, for the offline default.
CLAIM_WORDS = {
    "allergen": r"allergen|contains (?:milk|soy|egg|nuts|wheat)",
    "net_weight": r"net (?:wt|weight|quantity)",
    "nutrition_fact": r"calorie|sodium|fiber|saturated fat|sugar",
    "serving_size": r"serving size",
    "ingredient": r"ingredient",
    "disease_claim": r"cures?|treats?|prevents?",
    "health_claim": r"health",
    "storage_instruction": r"refrigerate|store in",
    "manufacturer_info": r"manufactured|distributed by",
    "expiration": r"expir|best by",
}


def whole(documents: DataFrame) -> DataFrame:
    """(document_id, text) of the documents without error; the text is full_text where uploads have it."""
    text = F.coalesce("full_text", "text") if "full_text" in documents.columns else F.col("text")
    return documents.where("error is null").select("document_id", text.alias("text")).where("text is not null")


def claims_offline(documents: DataFrame) -> DataFrame:
    """(document_id, claim_no, claim_text, claim_type, location_hint): sentences of the whole text that look like claims."""
    kind = F.lit("other")
    for name, pattern in reversed(CLAIM_WORDS.items()):
        kind = F.when(F.lower("claim_text").rlike(pattern), name).otherwise(kind)
    parts = F.split("text", R.SENTENCE_END)
    rows = whole(documents).select("document_id", F.posexplode(parts).alias("claim_no", "claim_text"))
    return rows.withColumn("claim_type", kind).where("claim_type <> 'other'").withColumn("location_hint", F.concat(F.lit("sentence "), (F.col("claim_no") + 1).cast("string")))


def map_claims(claims: DataFrame, points: DataFrame, top: int = TOP, scorer: Callable[[Column, Column], Column] = overlap_score) -> DataFrame:
    """Claims with top_chunks, reranked, and mapping_confidence; empty claims are left out, all claims go in one job.

    mapping_confidence is the reranker's score of the first chunk, else its fused score, else 0.
    """
    asked = claims.where(F.length("claim_text") > 0)
    key = F.concat_ws("\u0001", F.col("document_id").cast("string"), F.col("claim_no").cast("string"))
    text = F.when(F.length("claim_type") > 0, F.concat(F.col("claim_type"), F.lit(": "), F.col("claim_text"))).otherwise(F.col("claim_text"))
    queries = encode(asked.select(key.alias("query_id"), text.alias("query")), "query").withColumnRenamed("dense", "vector")
    hits = retrieval.search(points, queries, top_k=top, use_reranker=True, scorer=scorer)
    lists = hits.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("rank", "chunk_id", "cfr_citation", "text", F.col("rrf_score").alias("score"), "reranker_score"))).alias("top_chunks"))
    first = F.try_element_at("top_chunks", F.lit(1))
    return asked.withColumn("query_id", key).join(lists, "query_id", "left").withColumn("mapping_confidence", F.coalesce(first["reranker_score"], first["score"], F.lit(0.0))).drop("query_id")


def claim_context(mapped: DataFrame, most: int = 3, chars: int = 600) -> DataFrame:
    """``mapped`` with ``context``, for a judge that reads: its first chunks with a text, a citation line above each."""
    shown = F.filter(F.slice("top_chunks", 1, most), lambda c: F.coalesce(c["text"], F.lit("")) != "")
    lines = F.transform(shown, lambda c: F.concat(F.lit("["), F.coalesce(c["cfr_citation"], F.lit("")), F.lit("]\n"), R.first_chars(c["text"], chars)))
    return mapped.withColumn("context", F.when(F.coalesce(F.size(lines), F.lit(0)) > 0, F.array_join(lines, "\n\n")).otherwise("No relevant sections found."))


def classify(mapped: DataFrame, judge: Callable[[Column, Column], Column]) -> DataFrame:
    """Findings of the claims that ``judge`` (claim_type, confidence) gives a struct(violation_type, severity).

    Claims judged null or compliant (by a field compliant or by the type) are dropped; type and severity
    default to incorrect and medium.
    """
    verdict = mapped.withColumn("_v", judge(F.col("claim_type"), F.col("mapping_confidence")))
    fine = F.coalesce(F.col("_v.violation_type") == "compliant", F.lit(False))
    if "compliant" in verdict.schema["_v"].dataType.fieldNames():
        fine = fine | F.coalesce(F.col("_v.compliant"), F.lit(False))
    kept = verdict.where(F.col("_v").isNotNull() & ~fine)
    first = F.try_element_at("top_chunks", F.lit(1))
    return kept.select(
        "document_id", F.col("claim_no").alias("seq"), "claim_text", "claim_type", "location_hint", first["cfr_citation"].alias("cfr_citation"),
        F.coalesce("_v.violation_type", F.lit("incorrect")).alias("violation_type"), F.coalesce("_v.severity", F.lit("medium")).alias("severity"),
        F.lit("").alias("explanation"), F.coalesce(R.first_chars(first["text"], 400), F.lit("")).alias("relevant_cfr_text"),
    )


def gaps(documents: DataFrame, required: dict[str, str], severity: str = "high") -> DataFrame:
    """A finding per required element whose pattern a document's whole text lacks; after the claims' findings."""
    tests = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(name).alias("element"), F.lower("text").rlike(p).alias("there")) for i, (name, p) in enumerate(required.items())])
    lost = whole(documents).select("document_id", F.explode(F.filter(tests, lambda t: ~t["there"])).alias("g"))
    text = lambda v: F.lit(v).cast("string")
    return lost.select(
        "document_id", (F.lit(1_000_000) + F.col("g.i")).alias("seq"), F.concat(F.lit("[Missing element] "), F.coalesce("g.element", F.lit("Unknown"))).alias("claim_text"), text("missing_required_element").alias("claim_type"),
        text("entire document").alias("location_hint"), text(None).alias("cfr_citation"), text("missing").alias("violation_type"), text(severity).alias("severity"), text("").alias("explanation"), text("").alias("relevant_cfr_text"),
    )


def analyse(documents: DataFrame, points: DataFrame, judge: Callable[[Column, Column], Column], required: dict[str, str]) -> DataFrame:
    """A report per document; those with an error skip the analysis and still have a report."""
    found = classify(map_claims(claims_offline(documents), points), judge).unionByName(gaps(documents, required))
    return reports.severity_report(documents, found.select("document_id", "seq", "severity", F.col("claim_text").alias("text")))

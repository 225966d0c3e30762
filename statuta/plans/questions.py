"""Questions over the store: plan, retrieve, define, answer, verify and compare, as a bounded loop.

Each step maps a DataFrame keyed by query_id to another. The loop runs over the questions that are
not verified yet, writes each round, and ends after the second plan.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from statuta.functions import regulatory as R
from statuta.operators import retrieval
from statuta.plans.providers import encode, overlap_score
from statuta.runtime import cut, small

MOST_PLANS, MOST_TERMS, PRIMARY, REFERENCED, PER_QUESTION = 2, 10, 8, 4, 10
#: Sources and referenced sources that a verifier sees, characters of a question at least, and sub-questions at most.
CHECKED, CHECKED_REFERENCED, LEAST_CHARS, MOST_PARTS = 10, 5, 5, 4
NO_ANSWER = "No answer could be generated."
#: Columns of the points and the columns of a plan that restrict them.
FILTERS = {"part_number": "filter_part", "section_number": "filter_section", "chapter_number": "filter_chapter"}


def plan_offline(rows: DataFrame) -> DataFrame:
    """intent, sub_questions and part/section/chapter filters from the words of the question.

    Where ``issues`` say what the last answer lacked, a sub-question asks for it.
    """
    section = F.regexp_extract("query", r"(?i)(?:§|section)\s*(\d+\.\d+)", 1)
    part = F.regexp_extract("query", r"(?i)\bpart\s+(\d+)", 1)
    chapter = F.regexp_extract("query", r"\b[Cc]hapter\s+([IVXLC]+)\b", 1)
    kind = F.when(F.lower("query").rlike(r"defin|mean of|what is an? "), "definition_lookup").when(F.lower("query").rlike(r"differ|compare|versus"), "comparison").otherwise("compliance_question")
    parts = F.filter(F.split("query", r"(?i)\?\s+|\s+and\s+(?=what|when|how|which)"), lambda q: F.length(F.trim(q)) > 4)
    parts = F.when(F.size(parts) > 0, parts).otherwise(F.array("query"))
    if "issues" in rows.columns:
        again = F.concat_ws(" ", "query", F.array_join("issues", " "))
        parts = F.when(F.size("issues") > 0, F.concat(F.slice(parts, 1, MOST_PARTS - 1), F.array(again))).otherwise(parts)
    return rows.withColumns({"intent": kind, "sub_questions": F.slice(parts, 1, MOST_PARTS), "filter_chapter": F.nullif(chapter, F.lit("")), "filter_part": F.nullif(part, F.lit("")), "filter_section": F.nullif(section, F.lit(""))})


@dataclass(frozen=True)
class Steps:
    """The steps that a model may replace. plan, answer and verify map a DataFrame keyed by query_id to another.

    define gives the rows of resolve_terms from the retrieved rows and the points; scorer and judge
    give a score of (query, text) and whether two texts conflict.
    """

    plan: Callable[[DataFrame], DataFrame] = plan_offline
    answer: Callable[[DataFrame], DataFrame] = None
    verify: Callable[[DataFrame], DataFrame] = None
    define: Callable[[DataFrame, DataFrame], DataFrame] = None
    scorer: Callable[[Column, Column], Column] = overlap_score
    judge: Callable[[Column, Column], Column] = None


def complete(points: DataFrame) -> DataFrame:
    """``points`` with the columns that a store may lack: chunk_id is then the id, all else is null."""
    kinds = {"chunk_type": "string", "section_preamble": "string", "defines": "string", "chapter_number": "string", "cross_references_internal": "array<string>", "overflow_sequence": "struct<next_chunk_id: string>"}
    kinds = {c: F.lit(None).cast(kind) for c, kind in kinds.items()} | {"chunk_id": F.col("point_id")}
    return points.withColumns({c: value for c, value in kinds.items() if c not in points.columns})


def _hybrid(points: DataFrame, asked: DataFrame, filters: dict[str, str], top: int) -> DataFrame:
    """Fused ranks of the queries (query_id, query, dense), each over the points that its filters leave."""
    plain = asked.withColumnRenamed("dense", "vector").withColumn("scope", retrieval.scope_of(filters))
    kept, scope = retrieval.in_scopes(points, plain, filters), ["scope"]
    dense = retrieval.dense_search(kept, plain, scope=scope)
    sparse = retrieval.sparse_search(retrieval.terms(kept, "point_id", also=scope), retrieval.terms(plain, "query_id", "query", also=scope).withColumnRenamed("id", "query_id"), scope=scope)
    return retrieval.fuse(dense, sparse, top=top)


def retrieve(planned: DataFrame, points: DataFrame, scorer: Callable[[Column, Column], Column] = overlap_score) -> DataFrame:
    """(query_id, chunk_id, sq, rank, overflow_chunks, ...): reranked top 10 of each sub-question, the first sub-question winning.

    Filters of a question restrict its points before ranking. ``planned`` may have filter_chapter.
    """
    points = complete(points)
    filters = {name: column for name, column in FILTERS.items() if column in planned.columns}
    asked = planned.select("query_id", *filters.values(), F.posexplode("sub_questions").alias("sq", "query"))
    asked = encode(asked.select(F.concat_ws("\u0001", "query_id", F.col("sq").cast("string")).alias("query_id"), "query", *filters.values()), "query")
    fused = small(_hybrid(points, asked, filters, retrieval.FUSED_TOP), "fused")
    full = points.drop("dense", "sparse").withColumnRenamed("point_id", "id").join(fused, "id").join(asked.select("query_id", "query"), "query_id")
    best = retrieval.rerank(full, scorer, PER_QUESTION).drop("query")
    back = best.withColumns({"sq": F.split("query_id", "\u0001")[1].cast("int"), "query_id": F.split("query_id", "\u0001")[0]})
    return retrieval.expand_overflow(retrieval.keep_first(back, ["query_id", "id"], ["sq", "rank"]), points)


def referenced(planned: DataFrame, retrieved: DataFrame, points: DataFrame) -> DataFrame:
    """(query_id, chunk_id, section, cfr_citation, text, rank): the three best chunks, for the whole question, of each section that its retrieved chunks refer to."""
    points = complete(points)
    refs = retrieved.select("query_id", F.explode("cross_references_internal").alias("section")).where("section is not null").distinct()
    asked = encode(refs.join(planned.select("query_id", "query"), "query_id").select(F.concat_ws("\u0001", "query_id", "section").alias("query_id"), "query", "section"), "query")
    fused = _hybrid(points, asked, {"section_number": "section"}, 3)
    scored = fused.select(F.split("query_id", "\u0001")[0].alias("query_id"), F.col("id").alias("point_id"), (-F.col("fused_rank")).alias("score"))
    scored = cut(scored.join(points.select("point_id", "chunk_id"), "point_id").drop("point_id"), "referenced")
    found = retrieval.cross_references(retrieved, points, scored).join(scored, ["query_id", "chunk_id"])
    return found.withColumn("rank", -F.col("score")).drop("score").join(points.select("chunk_id", "cfr_citation", "text"), "chunk_id")


def context(retrieved: DataFrame, defined: DataFrame | None = None, others: DataFrame | None = None, primary: int = PRIMARY, chars: int = 800) -> DataFrame:
    """(query_id, context, retrieved_sections): definitions, numbered sources with their next parts, then sources they refer to.

    Every text is cut for the prompt: sources to ``chars``, definitions to 500, referenced ones to 600.
    Sources without any text are left out, but their sections are named.
    """
    cite = F.coalesce("cfr_citation", F.lit("Unknown section")).alias("cite")
    ordered = F.array_sort(F.collect_list(F.struct("sq", "rank", cite, F.concat_ws(" ", "section_preamble", "text", F.array_join(F.transform("overflow_chunks", lambda x: x["text"]), " ")).alias("full"))))
    rows = retrieved.groupBy("query_id").agg(ordered.alias("_s"))
    lines = F.transform(F.slice(F.filter("_s", lambda x: F.trim(x["full"]) != ""), 1, primary), lambda x, i: F.concat(F.lit("["), (i + 1).cast("string"), F.lit("] "), x["cite"], F.lit("\n"), R.first_chars(F.trim(x["full"]), chars)))
    rows = rows.select("query_id", F.array_join(lines, "\n").alias("_lines"), F.array_distinct(F.transform("_s", lambda x: x["cite"])).alias("retrieved_sections"))
    blocks = [F.col("_lines")]
    if defined is not None:
        of = F.array_sort(F.collect_list(F.struct("term", F.concat(F.lit("• "), "term", F.lit(": "), R.first_chars(F.col("text"), 500)).alias("line"))))
        rows = rows.join(defined.groupBy("query_id").agg(F.array_join(F.transform(of, lambda x: x["line"]), "\n").alias("_terms")), "query_id", "left")
        blocks = [F.col("_terms"), *blocks]
    if others is not None:
        of = F.slice(F.array_sort(F.collect_list(F.struct("section", "rank", "chunk_id", cite, F.coalesce("text", F.lit("")).alias("text")))), 1, REFERENCED)
        text = F.transform(of, lambda x, i: F.concat(F.lit("[X"), (i + 1).cast("string"), F.lit("] "), x["cite"], F.lit("\n"), R.first_chars(x["text"], 600)))
        rows = rows.join(others.groupBy("query_id").agg(F.array_join(text, "\n").alias("_others")), "query_id", "left")
        blocks = [*blocks, F.col("_others")]
    return rows.select("query_id", F.concat_ws("\n\n", *blocks).alias("context"), "retrieved_sections")


def evidence(retrieved: DataFrame, others: DataFrame, primary: int = CHECKED, referenced: int = CHECKED_REFERENCED, chars: int = 600) -> DataFrame:
    """(query_id, evidence): what a verifier compares an answer with, ``[citation] text`` of the first sources and referenced ones."""
    line = F.concat(F.lit("["), F.coalesce("cfr_citation", F.lit("")), F.lit("] "), R.first_chars(F.coalesce("text", F.lit("")), chars)).alias("line")
    first = retrieved.select("query_id", F.lit(0).alias("kind"), F.struct(F.lit("").alias("section"), F.col("sq").cast("double").alias("a"), F.col("rank").cast("double").alias("b"), "chunk_id").alias("place"), line)
    then = others.select("query_id", F.lit(1).alias("kind"), F.struct("section", F.col("rank").cast("double").alias("a"), F.lit(0.0).alias("b"), "chunk_id").alias("place"), line)
    lines = lambda kind, most: F.transform(F.slice(F.array_sort(F.collect_list(F.when(F.col("kind") == kind, F.struct("place", "line")))), 1, most), lambda x: x["line"])
    return first.unionByName(then).groupBy("query_id").agg(F.array_join(F.concat(lines(0, primary), lines(1, referenced)), "\n---\n").alias("evidence"))


def checked_questions(questions: DataFrame) -> DataFrame:
    """``questions`` (query_id, query) with ``error``: null for those that ``ask`` answers."""
    return questions.withColumn("error", F.when(F.coalesce(F.length("query"), F.lit(0)) < LEAST_CHARS, f"a question has at least {LEAST_CHARS} characters"))


def answer_offline(rows: DataFrame) -> DataFrame:
    """draft_answer is the first source's text; confidence grows with the sources found."""
    first = F.regexp_extract("context", r"(?s)(?:^|\n)\[1\] [^\n]*\n(.*?)(?:\n\[2\]|\n\n\[X1\]|$)", 1)
    return rows.withColumns({"draft_answer": first, "citations": F.slice("retrieved_sections", 1, 3), "confidence_score": R.clamp(F.size("retrieved_sections") / 10)})


def verify_offline(rows: DataFrame) -> DataFrame:
    """Passed if every number of the draft stands in the context; a missing verdict passes."""
    numbers = F.array_distinct(F.regexp_extract_all("draft_answer", F.lit(r"\d+(?:\.\d+)?"), 0))
    missing = F.filter(numbers, lambda n: ~F.contains(F.concat_ws(" ", "context", "evidence"), n))
    return rows.withColumns({"verification_issues": missing, "verification_passed": F.coalesce(F.size(missing) == 0, F.lit(True))})


def judge_offline(a: Column, b: Column) -> Column:
    """Whether one of two texts on the same matter has an exception or a prohibition that the other has not."""
    words = lambda c: F.array_distinct(F.filter(F.split(F.lower(c), "[^a-z]+"), lambda w: F.length(w) > 3))
    alike = F.size(F.array_intersect(words(a), words(b))) * 2 >= F.least(F.size(words(a)), F.size(words(b)))
    apart = lambda c: F.lower(c).rlike(r"\b(?:not|exempt|except|unless|prohibited)\b")
    return alike & (F.least(F.size(words(a)), F.size(words(b))) > 0) & (apart(a) != apart(b))


def ask(questions: DataFrame, points: DataFrame, steps: Steps | None = None) -> DataFrame:
    """A row per question (query_id, query of at least 5 characters) with answer, citations and checks.

    A question that fails verification is planned once more with the verifier's issues, and its second
    answer stands; what was retrieved the first time is replaced. Shorter questions have no row (see
    ``checked_questions``). A null draft, the mark of a model that failed, gives ``NO_ANSWER`` without
    citations and confidence. The row has the definitions of terms, the chunks of sections referred
    to, and the pairs of sources that conflict.
    """
    steps = steps or Steps()
    open_, done = checked_questions(questions).where("error is null").select("query_id", "query"), None
    for attempt in range(1, MOST_PLANS + 1):
        planned = cut(steps.plan(open_), "planned")
        retrieved = cut(retrieve(planned, points, steps.scorer), "retrieved")
        defined = cut((steps.define or resolve_terms)(retrieved, complete(points)), "defined")
        others = cut(referenced(planned, retrieved, points), "others")
        drafted = (steps.answer or answer_offline)(planned.join(context(retrieved, defined, others), "query_id", "left"))
        drafted = drafted.join(evidence(retrieved, others), "query_id", "left")
        checked = (steps.verify or verify_offline)(drafted).withColumn("retry_count", F.lit(attempt - 1) + F.when(F.col("verification_passed"), 0).otherwise(1))
        checked = cut(checked, "answers")
        final = checked if attempt == MOST_PLANS else checked.where("verification_passed")
        terms = defined.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("term", "chunk_id", "text"))).alias("definitions"))
        refs = others.groupBy("query_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("section", "rank", "chunk_id"))), lambda x: x["chunk_id"]).alias("cross_ref_chunks"))
        flags = conflicts(retrieved.join(final.select("query_id"), "query_id", "left_semi"), steps.judge or judge_offline)
        flags = flags.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("cite_a", "cite_b"))).alias("conflict_details"))
        for more in (terms, refs, flags):
            final = final.join(more, "query_id", "left")
        done = final if done is None else done.unionByName(final, allowMissingColumns=True)
        if attempt < MOST_PLANS:
            issues = F.col("verification_issues") if "verification_issues" in checked.columns else F.expr("cast(array() as array<string>)")
            open_ = checked.where("not verification_passed").select("query_id", "query", issues.alias("issues"))
            if open_.limit(1).count() == 0:
                break
    none = F.expr("cast(array() as array<string>)")
    return done.select("query_id", "query", "intent", F.coalesce("draft_answer", F.lit(NO_ANSWER)).alias("answer"), F.when(F.col("draft_answer").isNull(), none).otherwise(F.coalesce("citations", none)).alias("citations"), F.when(F.col("draft_answer").isNull(), 0.0).otherwise(F.coalesce("confidence_score", F.lit(0.0))).alias("confidence_score"), F.coalesce("retrieved_sections", none).alias("retrieved_sections"), "verification_passed", "retry_count", *[F.coalesce(c, F.expr(f"cast(array() as {done.schema[c].dataType.simpleString()})")).alias(c) for c in ("definitions", "cross_ref_chunks", "conflict_details")], (F.coalesce(F.size("conflict_details"), F.lit(0)) > 0).alias("conflicts_detected"))


def resolve_terms(retrieved: DataFrame, points: DataFrame) -> DataFrame:
    """(query_id, term, chunk_id, text): definitions of the known terms that retrieved texts use, at most 10 a question."""
    known = points.where("chunk_type = 'definition' and defines is not null").select("defines", F.col("point_id").alias("def_id"), F.col("text").alias("definition"))
    used = retrieved.select("query_id", F.explode(F.array_distinct(F.split(F.lower("text"), "[^a-z]+"))).alias("word"), "text").where("word <> ''")
    starts = known.withColumn("word", F.try_element_at(F.array_remove(F.split(F.lower("defines"), "[^a-z]+"), ""), F.lit(1)))
    found = used.join(starts, "word").where(F.contains(F.lower("text"), F.lower("defines")))
    best = retrieval.keep_first(found.select("query_id", F.col("defines").alias("term"), F.col("def_id").alias("chunk_id"), F.col("definition").alias("text")), ["query_id", "term"], ["chunk_id"])
    return best.withColumn("_n", F.expr("row_number() over (partition by query_id order by term)")).where(F.col("_n") <= MOST_TERMS).drop("_n")


def conflicts(retrieved: DataFrame, judge: Callable[[Column, Column], Column], most: int = PRIMARY) -> DataFrame:
    """(query_id, cite_a, cite_b) where ``judge`` says that two of a question's first sources conflict.

    At most ``most`` sources a question are compared, so its pairs are bounded.
    """
    top = retrieved.withColumn("_n", F.expr("row_number() over (partition by query_id order by sq, rank)")).where(F.col("_n") <= most)
    a = top.select("query_id", F.col("_n").alias("n_a"), F.col("cfr_citation").alias("cite_a"), F.col("text").alias("text_a"))
    b = top.select("query_id", F.col("_n").alias("n_b"), F.col("cfr_citation").alias("cite_b"), F.col("text").alias("text_b"))
    return a.join(b, "query_id").where("n_a < n_b").where(F.coalesce(judge(F.col("text_a"), F.col("text_b")), F.lit(False))).select("query_id", "cite_a", "cite_b")

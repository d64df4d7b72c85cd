"""Evaluation of whole runs: where expected answers stand, one record per question, grading, the report."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docquarry.functions.text import normalize_identifier
from docquarry.operators import evaluate as E
from docquarry.operators.retrieval import small
from docquarry.scratch import materialize

# The outcomes that a grading may name.
CORRECTNESS, GROUNDING, SUPPORT = ("correct", "partially_correct", "incorrect"), ("grounded", "weakly_grounded", "unsupported"), ("explicit", "implicit", "not_found")
FAILURES = ("no_failure", "benchmark_data_mismatch", "document_resolution_failure", "retrieval_failure", "selection_failure", "generation_failure")
CONTEXT_CHARS, QUESTION_CHARS, ANSWER_CHARS, CONTEXTS = 6000, 1000, 500, 5
#: Characters of a gram, by which containment is looked up.
GRAM = 3
#: Questions whose variants are held against a text in one row.
TOGETHER = 500


def expected_variants(questions: DataFrame) -> DataFrame:
    """id, variant: the expected and accepted answers of each question, trimmed, each normalized form once, the first as written."""
    every = F.concat(F.array("expected_answer"), F.coalesce("accepted_answers", F.expr("cast(array() as array<string>)")))
    rows = questions.select("id", F.posexplode(every).alias("pos", "raw")).select("id", "pos", F.trim("raw").alias("variant")).withColumn("key", normalize_identifier(F.col("variant")))
    return rows.where("key <> ''").groupBy("id", "key").agg(F.min(F.struct("pos", "variant")).alias("v")).select("id", F.col("v.variant").alias("variant"))


def _grams(words: Column) -> Column:
    """The different runs of GRAM characters within words."""
    long = F.filter(F.array_distinct(words), lambda w: F.length(w) >= GRAM)
    return F.array_distinct(F.flatten(F.transform(long, lambda w: F.transform(F.sequence(F.lit(1), F.length(w) - GRAM + 1), lambda i: F.substring(w, i, F.lit(GRAM))))))


def gram_candidates(entries: DataFrame, needles: DataFrame) -> DataFrame:
    """entry, needle: pairs in which the entry has the needle's rarest gram. An entry whose text contains all of a needle's words is among them.

    entries: entry, words; needles: needle, words (of GRAM characters at least one; others have no pairs). Two passes over the entries: how many have each gram of the
    needles, then the entries that have a chosen one. Nothing else of an entry travels.
    """
    asked = needles.select("needle", F.explode(_grams(F.col("words"))).alias("gram"))
    held = entries.select("entry", F.explode(_grams(F.col("words"))).alias("gram"))
    counts = held.join(small(asked.select("gram").distinct()), "gram", "left_semi").groupBy("gram").agg(F.count(F.lit(1)).alias("n"))
    rarest = asked.join(counts, "gram", "left").groupBy("needle").agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "gram")).alias("r"))
    return held.join(small(rarest.where("r.n > 0").select("needle", F.col("r.gram").alias("gram"))), "gram").select("entry", "needle")


def word_candidates(entries: DataFrame, needles: DataFrame) -> DataFrame:
    """entry, needle: pairs in which a word of the entry contains the needle's rarest word. An entry whose text contains all of a needle's words is among them.

    entries and needles as in gram_candidates(), which is asked of the different words of all entries alone: which of them contain a word of a needle. Entries
    then meet needles by whole words, and nothing else of an entry travels.
    """
    asked = needles.select("needle", F.explode(F.array_distinct(F.filter("words", lambda w: F.length(w) >= GRAM))).alias("part"))
    held = entries.select("entry", F.explode_outer(F.array_distinct("words")).alias("word"))
    counted = materialize(held.groupBy("word").agg(F.count(F.lit(1)).alias("n")), "vocabulary")
    inside = gram_candidates(counted.select(F.col("word").alias("entry"), F.array("word").alias("words")), asked.select(F.col("part").alias("needle"), F.array("part").alias("words")).distinct())
    inside = materialize(inside.where(F.contains("entry", "needle")).distinct().toDF("word", "part"), "word-parts")
    totals = inside.join(counted, "word").groupBy("part").agg(F.sum("n").alias("n"))
    rarest = asked.join(totals, "part", "left").groupBy("needle").agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "part")).alias("r"))
    wanted = inside.join(rarest.where("r.n > 0").select("needle", F.col("r.part").alias("part")), "part").select("word", "needle")
    return held.join(small(wanted), "word").select("entry", "needle")


def _without_grams(needles: DataFrame) -> DataFrame:
    return needles.where(~F.exists("words", lambda w: F.length(w) >= GRAM))


def contained_pairs(texts: DataFrame, needles: DataFrame) -> DataFrame:
    """entry, needle: texts (entry, plain) that contain needles (needle, plain) as substrings; both normalized. Only needles without a word of GRAM characters meet every text."""
    words = lambda df, name: df.select(name, F.split("plain", " ").alias("words"))
    wanted = words(needles, "needle")
    short = _without_grams(wanted).select("needle")
    pairs = gram_candidates(words(texts, "entry"), wanted)
    if not short.isEmpty():
        pairs = pairs.unionByName(texts.select("entry").crossJoin(small(short)))
    return pairs.join(texts, "entry").join(needles.withColumnRenamed("plain", "inner"), "needle").where(F.contains("plain", "inner")).select("entry", "needle").distinct()


def fitting_names(names: DataFrame, sources: DataFrame) -> DataFrame:
    """document_name, source_document: names and sources of which one contains the other, both normalized and not empty."""
    plain = lambda df, c: materialize(df.select(F.col(c), normalize_identifier(F.col(c)).alias("plain")).where("plain <> ''"), "names")
    n, s = plain(names, "document_name"), plain(sources, "source_document")
    inside = contained_pairs(n.withColumnRenamed("document_name", "entry"), s.withColumnRenamed("source_document", "needle")).toDF("document_name", "source_document")
    around = contained_pairs(s.withColumnRenamed("source_document", "entry"), n.withColumnRenamed("document_name", "needle")).toDF("source_document", "document_name")
    return inside.unionByName(around).distinct()


def _value_keys(f: Column) -> Column:
    """What a text says in figures, each as a key of its kind; an amount or a percentage may also stand as a plain number."""
    tagged = lambda tag, values: F.transform(values, lambda x: F.concat(F.lit(tag), x.cast("string")))
    text = lambda values: F.transform(values, lambda x: x.cast("string"))
    n = text(f["numbers"])
    return F.array_distinct(F.concat(tagged("n", n), tagged("d", text(f["dates"])), tagged("a", F.array_union(text(f["amounts"]), n)), tagged("p", F.array_union(text(f["percents"]), n))))


def _value_key(f: Column) -> Column:
    """One key that every text with all of a variant's figures has."""
    first = lambda tag, values: F.when(F.size(values) > 0, F.concat(F.lit(tag), values[0].cast("string")))
    return F.coalesce(first("n", f["numbers"]), first("d", f["dates"]), first("a", f["amounts"]), first("p", f["percents"]))


def corpus_hits(questions: DataFrame, variants: DataFrame, corpus: DataFrame) -> DataFrame:
    """id, candidate_id, document_name, level: entries that support an expected answer, explicit before implicit.

    Where a question names a source, only the entries of documents that the name fits count, and the two meet by the document's
    name. Otherwise an index proposes what is then judged: whatever supports a variant contains its telling words, hence the rarest
    run of characters of these; a variant of figures alone is found by its characters or by one of its values. Only variants
    without either (a text of one or two letters) are held against every entry, a stated set in one broadcast.
    """
    asked = materialize(questions.select("id", "source_document").join(variants, "id").select("id", "source_document", E.features(F.col("variant")).alias("v")), "asked")
    seen = corpus.select("candidate_id", "document_name", "text")
    bound = F.coalesce(F.col("source_document"), F.lit("")) != ""
    fits = fitting_names(corpus.select("document_name").distinct(), asked.where(bound).select("source_document").distinct())
    named = materialize(fits.join(asked.where(bound), "source_document").select("id", "v", "document_name"), "asked-named")

    free = asked.where(~bound).select(F.struct("id", "v.plain").alias("needle"), "id", "v")
    telling = E.telling_words(F.col("v"))
    free = materialize(free.withColumn("words", F.when(F.exists(telling, lambda w: F.length(w) >= GRAM), telling).otherwise(F.split("v.plain", " "))).withColumn("told", F.exists(telling, lambda w: F.length(w) >= GRAM)), "asked-free")
    judged = materialize(seen.select("candidate_id", "document_name", E.judged_by(F.col("text")).alias("t")), "judged")  # each text is read once, not once a question
    entries = judged.select(F.col("candidate_id").alias("entry"), F.split("t.plain", " ").alias("words"))
    pairs = word_candidates(entries, free.select("needle", "words"))
    figures = free.where(~F.col("told")).select("needle", _value_key(F.col("v")).alias("key")).where("key IS NOT NULL")
    if not figures.isEmpty():
        values = judged.select(F.col("candidate_id").alias("entry"), F.explode(_value_keys(F.col("t"))).alias("key"))
        pairs = pairs.unionByName(values.join(small(figures), "key").select("entry", "needle"))
    short = _without_grams(free.select("needle", "words")).select("needle")
    if not short.isEmpty():
        pairs = pairs.unionByName(seen.select(F.col("candidate_id").alias("entry")).crossJoin(small(short)))
    proposed = pairs.distinct().withColumnRenamed("entry", "candidate_id").join(small(free.select("needle", "id", "v")), "needle")
    parts = questions.count() // TOGETHER + 1
    listed = lambda df, c: df.groupBy(c, F.pmod(F.xxhash64("id"), F.lit(parts)).alias("part")).agg(F.collect_list(F.struct("id", "v")).alias("needles")).drop("part")
    # a text goes once to the variants of many questions, not once to each
    every = judged.join(listed(proposed, "candidate_id"), "candidate_id").unionByName(judged.join(small(listed(named, "document_name")), "document_name"))
    found = F.transform("needles", lambda n: F.struct(n["id"].alias("id"), E.support_of(F.col("t"), n["v"]).alias("level")))
    # outer: for a plain explode Spark infers filters that work the list out again
    levels = every.select("candidate_id", "document_name", F.explode_outer(F.filter(found, lambda x: x["level"] != "not_found")).alias("h")).where("h is not null")
    return levels.groupBy("h.id", "candidate_id", "document_name").agg(F.min("h.level").alias("level"))


def grounding(evidence_level: Column, answer_has_expected: Column) -> Column:
    return F.when((evidence_level == "explicit") & answer_has_expected, "grounded").when(evidence_level.isin("explicit", "implicit"), "weakly_grounded").otherwise("unsupported")


def answer_confidence(status: Column, retrieval_score: Column, abstained: Column) -> Column:
    """The retrieval score raised or lowered by how well the answer stands on its evidence; nothing where it abstained."""
    score = F.coalesce(retrieval_score, F.lit(0.0))
    return F.when(abstained, F.lit(0.0)).when(status == "grounded", F.least(F.lit(1.0), score + 0.20)).when(status == "weakly_grounded", F.least(F.lit(1.0), score + 0.05)).otherwise(F.greatest(F.lit(0.0), score - 0.25))


def question_results(questions: DataFrame, hits: DataFrame, stages: DataFrame, answers: DataFrame, corpus: DataFrame) -> DataFrame:
    """One row per question: hits, in_pool, in_context, evidence_level, grounding, confidence, context_hit_rate, failure.

    questions: id; hits: id, candidate_id; stages: query_id, stage, candidate_ids with stages candidate_pool and selected_context;
    answers: id, answer, abstained, evidence_score, explicit_scope, scope_excludes; corpus: candidate_id, document_name, text.
    """
    positions = E.stage_positions(stages).withColumnRenamed("query_id", "id")
    ours = hits.select("id", "candidate_id").distinct()
    at = lambda stage, name: positions.where(F.col("stage") == stage).select("id", "candidate_id", F.lit(True).alias(name))
    met = ours.join(at("candidate_pool", "pool"), ["id", "candidate_id"], "left").join(at("selected_context", "context"), ["id", "candidate_id"], "left")
    counts = met.groupBy("id").agg(F.count(F.lit(1)).alias("hits"), F.count("pool").alias("pool_hits"), F.count("context").alias("context_hits"))
    selected = at("selected_context", "context").join(hits.select("id", "candidate_id", "level"), ["id", "candidate_id"]).groupBy("id").agg(F.min("level").alias("evidence_level"))
    variants = expected_variants(questions)
    said = answers.join(variants, "id").groupBy("id").agg(F.bool_or(E.support_level(F.col("answer"), F.col("variant")) != "not_found").alias("answer_has_expected"))
    one = questions.select("id").join(counts, "id", "left").join(selected, "id", "left").join(answers, "id", "left").join(said, "id", "left")
    n = lambda c: F.coalesce(F.col(c), F.lit(0))
    b = lambda c: F.coalesce(F.col(c), F.lit(False))
    one = one.withColumn("evidence_level", F.coalesce("evidence_level", F.lit("not_found"))).withColumn("grounding", grounding(F.col("evidence_level"), b("answer_has_expected")))
    failure = E.failure_class(n("hits"), b("explicit_scope"), b("scope_excludes"), n("pool_hits") > 0, n("pool_hits") > 0, n("context_hits") > 0, F.col("evidence_level") != "not_found", b("answer_has_expected"), b("abstained"))
    return one.select("id", n("hits").alias("hits"), (n("pool_hits") > 0).alias("in_pool"), (n("context_hits") > 0).alias("in_context"), "evidence_level", "grounding",
                      answer_confidence(F.col("grounding"), F.col("evidence_score"), b("abstained")).alias("confidence"), F.when(n("hits") > 0, F.round(n("context_hits") / n("hits"), 4)).otherwise(0.0).alias("context_hit_rate"),
                      failure.alias("failure"), b("abstained").alias("abstained"))


def checked_grading(status: Column, correctness: Column, grounding_status: Column, failure: Column, support: Column, confidence: Column) -> Column:
    """graded where every field is one of its values and the confidence lies within 0 and 1, else fallback. It never changes the rule-based result."""
    sound = correctness.isin(*CORRECTNESS) & grounding_status.isin(*GROUNDING) & failure.isin(*FAILURES) & support.isin(*SUPPORT) & confidence.between(0, 1)
    return F.when((status == "graded") & F.coalesce(sound, F.lit(False)), "graded").otherwise("fallback")


def cut_at_word(text: Column, limit: int = CONTEXT_CHARS) -> Column:
    """The first limit characters up to a space, if one stands in the last fifth, and a mark that the text was cut."""
    head = F.substring(text, 1, limit)
    last = F.length(head) - F.locate(" ", F.reverse(head))
    cut = F.when((F.locate(" ", head) > 0) & (last > limit * 0.8), last).otherwise(-1)
    kept = F.when(cut >= 0, F.left(head, cut.cast("int"))).otherwise(F.trim(head))
    return F.when(F.length(text) <= limit, text).otherwise(F.concat(kept, F.lit(" [...truncated]")))


def grader_payload(question: Column, expected: Column, answer: Column, context: Column, contexts: Column) -> Column:
    return F.struct(F.substring(question, 1, QUESTION_CHARS).alias("question"), F.substring(expected, 1, ANSWER_CHARS).alias("expected_answer"), F.substring(answer, 1, ANSWER_CHARS).alias("generated_answer"),
                    F.slice(contexts, 1, CONTEXTS).alias("selected_context"), cut_at_word(context).alias("answer_context"))


def clean_answer(text: Column) -> Column:
    """An answer without the mode heading before it and the navigation hint behind it."""
    no_head = F.regexp_replace(F.trim(text), r"^\*\*[A-ZÁÉÍÓÚÀÃÕÂÊÔ ]+\*\*\s*\n+", "")
    return F.regexp_replace(F.regexp_replace(no_head, r"(?is)\n+Para sair do modo.*$", ""), r"^\s+|\s+$", "")


def table_cell(text: Column) -> Column:
    return F.trim(F.replace(F.replace(text, F.lit("|"), F.lit("\\|")), F.lit("\n"), F.lit(" ")))


def report_lines(results: DataFrame) -> DataFrame:
    """line_no, line: counters, then one table row per question. One row a question; written out with df.write.text."""
    from docquarry.operators.ingest import _nth

    results = materialize(results, "report")  # counters, numbers and body read the rows, none works them out again
    total = E.run_counters(results).select(F.explode(F.array(F.lit("# Evaluation"), F.concat(F.lit("Questions: "), "questions"), F.concat(F.lit("Passed: "), "passed"), F.concat(F.lit("Abstained: "), "abstained", F.lit(" ("), "abstained_percent", F.lit("%)")), F.lit("| id | failure | grounding | confidence |"))).alias("line"))
    head = total.select((F.monotonically_increasing_id() - 1_000).alias("line_no"), "line")
    row = F.concat(F.lit("| "), table_cell(F.col("id")), F.lit(" | "), "failure", F.lit(" | "), "grounding", F.lit(" | "), F.format_string("%.2f", "confidence"), F.lit(" |"))
    body = _nth(results, [F.col("id")], "line_no").select("line_no", row.alias("line"))
    return head.unionByName(body)


def runnable(cases: DataFrame, present: DataFrame) -> DataFrame:
    """Cases (documents ARRAY) of which every document is there. present: document_name."""
    missing = cases.select("id", F.explode("documents").alias("document_name")).join(present.select("document_name").distinct(), "document_name", "left_anti").select("id").distinct()
    return cases.join(missing, "id", "left_anti")


def lookup_candidates(ids: DataFrame, catalog: DataFrame, corpus: DataFrame, key: str = "candidate_id") -> DataFrame:
    """ids with document_name and text of the catalog, or of the corpus where the catalog has none."""
    a, b = (df.select(key, F.struct("document_name", "text").alias(n)) for df, n in ((catalog, "a"), (corpus, "b")))
    joined = ids.join(a, key, "left").join(b, key, "left")
    return joined.select(*ids.columns, F.coalesce("a", "b").alias("c")).select(*ids.columns, "c.document_name", "c.text")


def pool_union(rankings: DataFrame) -> DataFrame:
    """query_id, candidate_ids: all different candidates of a question's hops in order of hop and rank."""
    ordered = F.array_sort(F.collect_list(F.struct("hop", "rank", "chunk_id")))
    return rankings.groupBy("query_id").agg(F.array_distinct(F.transform(ordered, lambda x: x["chunk_id"])).alias("candidate_ids"))


def query_list(resolved: Column, original: Column, planned: Column) -> Column:
    """The resolved question where it is the original one, then the planner's queries, each once; the resolved one if nothing is left."""
    from docquarry.functions.text import fold

    first = F.when(fold(resolved) == fold(original), F.array(resolved)).otherwise(F.expr("cast(array() as array<string>)"))
    every = F.array_distinct(F.concat(first, planned))
    return F.when(F.size(every) > 0, every).otherwise(F.array(resolved))

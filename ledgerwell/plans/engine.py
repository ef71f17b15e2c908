"""The engine as one object: corpus in, grounded and cited answers out, for batches of queries."""

from __future__ import annotations

import time
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field, replace
from itertools import islice

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from ledgerwell.config import Config
from ledgerwell.functions import lists, text
from ledgerwell.operators import answers, chunking, dense, grounding, hybrid, lexical, pairs, routing
from ledgerwell.operators import trace as steps
from ledgerwell.session import stored

#: Additions to an engine after which its tables are written as one again, so that a batch reads few parts.
PARTS = 8
#: Calls of a generator at a time.
CALLS = 8


@dataclass
class Engine:
    """Tables of a corpus and the settings that all steps read.

    documents: doc_id, title, field, category, text, origin. encoder: texts to unit rows, or None for lexical search alone.
    generate: (prompt) -> answer on the driver, from several threads, or None to quote. store: a folder in which the tables of a corpus are kept under
    its fingerprint, so that a later engine of the same corpus and settings reads them. base: an engine whose tables are kept, while
    documents are added to them.
    """

    documents: DataFrame
    brands: DataFrame | None = None
    encoder: object | None = None
    generate: object | None = None
    config: Config = field(default_factory=Config)
    store: str | None = None
    base: Engine | None = None

    def __post_init__(self):
        """Builds the tables that every batch of queries reads, or adds the rows of further documents to those of the base."""
        c, base = self.config, self.base
        self.steps: list[tuple[str, float]] = []
        self.rows: dict[str, int] = {}
        self.trace: DataFrame | None = None
        self.added = 0 if base is None else base.added + 1
        cut = chunking.chunk_table(self.documents, c.chunking.size, c.chunking.overlap)
        self._at = self._kept_at() if self.store and base is None else None
        fresh = self._table("chunks", lambda: chunking.numbered(cut) if base is None else chunking.numbered_on(base.chunks, cut))
        built = lexical.build_index(fresh)
        postings, lengths = self._table("postings", lambda: built.postings), self._table("lengths", lambda: built.lengths)
        frequencies = self._table("frequencies", lambda: postings.groupBy("term").agg(F.count("*").alias("df")))
        corpus = fresh.where(F.col("origin") == chunking.CORPUS)
        words = grounding.vocabulary(corpus)
        vocabulary = self._table("vocabulary", lambda: words if base is None else words.join(base.vocabulary, "token", "left_anti"))
        vectors = None
        if self.encoder:
            made = self._table("vectors", lambda: dense.encode(fresh.select("chunk_id", "text"), self.encoder).select("chunk_id", "embedding"))
            vectors = dense.require_aligned(fresh, dense.require_unit(made))
            if base is not None and base.vectors is None:
                old = base.chunks.select("chunk_id", "text")
                vectors = vectors.unionByName(stored(dense.encode(old, self.encoder).select("chunk_id", "embedding"), "engine-vectors"))
            elif base is not None:
                vectors = self._joined("vectors", base.vectors, vectors)
        self.chunks = self._joined("chunks", base and base.chunks, fresh)
        postings, lengths = self._joined("postings", base and base.index.postings, postings), self._joined("lengths", base and base.index.lengths, lengths)
        if base is not None:
            frequencies = self._joined("frequencies", base.frequencies, frequencies)
        self.frequencies = frequencies  # a row for each term and part
        counts = frequencies if base is None else frequencies.groupBy("term").agg(F.sum("df").alias("df"))
        self.index = lexical.Index(postings, lengths, counts, lengths.agg(F.count("*").alias("n"), F.avg("dl").alias("avgdl")))
        self.vectors, self.vocabulary = vectors, self._joined("vocabulary", base and base.vocabulary, vocabulary)
        self.uploads = self.chunks.where(F.col("origin") != chunking.CORPUS).select("chunk_id", "field")
        self.has_uploads = not self.uploads.isEmpty()

    def _joined(self, name: str, old: DataFrame | None, new: DataFrame) -> DataFrame:
        """The base's rows and the added ones, each where they are written; every PARTS additions all are written together."""
        if old is None:
            return new
        both = old.unionByName(new)
        return both if self.added % PARTS else stored(both, f"engine-{name}")

    def _kept_at(self) -> str:
        """The folder of this corpus under these settings and this encoder."""
        c = self.config.chunking
        model = f"{c.size}|{c.overlap}|{getattr(self.encoder, '__qualname__', type(self.encoder).__name__)}"
        return f"{self.store}/{chunking.content_digest(self.documents, model, 'doc_id', 'title', 'field', 'category', 'text', 'origin').first()['fingerprint']}"

    def _table(self, name: str, make) -> DataFrame:
        """A table kept under the fingerprint, made where there is none, or one of this session's own."""
        if self._at is None:
            return stored(make(), f"engine-{name}")
        spark, path = self.documents.sparkSession, f"{self._at}/{name}"
        done = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
        if not done.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(done):
            make().write.mode("overwrite").parquet(path)
        return spark.read.parquet(path)

    def extended(self, documents: DataFrame) -> Engine:
        """An engine with further documents; only their chunks are cut, counted, encoded and written."""
        return replace(self, documents=documents, base=self)

    def _measured(self, name: str, df: DataFrame) -> DataFrame:
        """df, written; the time that took is the step's, and the rows are counted as they pass."""
        start, seen = time.perf_counter(), Observation()
        out = stored(df.observe(seen, F.count(F.lit(1)).alias("rows")), f"engine-{name}")
        self.steps.append((name, 1000 * (time.perf_counter() - start)))
        self.rows[name] = seen.get["rows"]
        return out

    def _allowed(self, asked: DataFrame, grounded: DataFrame, lex: DataFrame, wanted: DataFrame | None, n: int) -> DataFrame:
        """(query_id, chunk_id) that can be among a query's results: chunks that hold a matched entity, and of the uploads those
        with a word of the query and the n nearest of each field that a boost tells apart.

        A chunk without a word of the query ranks by its dense score among those of its field, so the others of the uploads can't get
        among the best n, and no table of all uploads by all queries is made. Each query is matched or may read uploads, so that
        none has to draw on all chunks. Where words alone count (alpha 1) all of those rank alike, by number, and all are taken.
        """
        matched = grounded.where("entity is not null").select("query_id", F.col("entity").alias("token")).distinct()
        allowed = grounding.chunk_tokens(self.chunks).join(matched, "token").select("query_id", "chunk_id")
        if self.has_uploads:
            allowed = allowed.unionByName(lex.join(self.uploads.select("chunk_id"), "chunk_id").select("query_id", "chunk_id"))
            if wanted is not None:
                boosted = F.when(F.col("field").isin(*lists.RECORD_FIELDS), F.col("field")).otherwise("other")
                near = self.vectors.join(self.uploads, "chunk_id").select("chunk_id", "embedding", boosted.alias("field"))
                allowed = allowed.unionByName(dense.grouped_topk(near, wanted, n).select("query_id", "chunk_id"))
        return self._measured("allowed", allowed.join(asked.select("query_id"), "query_id", "left_semi").distinct())

    def retrieve(self, queries: DataFrame, persona: routing.Persona | None = None, k: int | None = None, rerank=None) -> tuple[DataFrame, DataFrame]:
        """(results, outcomes) for query_id, query. Scores are scaled over the whole corpus, then restricted, boosted, floored
        and cut; every query has an outcome with a status. trace, steps and rows tell what each step of the batch took and gave.

        Bounds over all chunks come from one pass over the vectors that keeps two numbers a query; scores are made for the chunks
        that a query may draw on."""
        r = self.config.retrieval
        k = (persona.fetch_k(k) if persona else k) or r.top_k
        self.steps, self.rows = [], {}
        grounded = self._measured("grounded", grounding.ground(queries, self.vocabulary, self.brands))
        out = self._measured("outcomes", grounding.outcomes(queries, grounded))
        open_ = out if self.has_uploads else out.where(F.size("matched") > 0)
        asked = open_.select("query_id", F.col("rewritten").alias("text"), text.cleaned(F.col("rewritten")).alias("clean"))
        lex = self._measured("lexical", lexical.bm25(self.index, asked, r.k1, r.b, r.idf))
        wanted = None if self.vectors is None else self._measured("queries", dense.encode(asked, self.encoder).select("query_id", "embedding"))
        n = r.pool if rerank is not None else k
        allowed = self._allowed(asked, grounded, lex, wanted, n if r.alpha < 1 or not self.has_uploads else self.uploads.count())
        if self.vectors is None:
            scored = hybrid.blend(lex, None, self.chunks, r.alpha).join(allowed, ["query_id", "chunk_id"], "left_semi")
        else:
            ends = dense.bounds(self.vectors, wanted)
            scored = hybrid.blend_pairs(allowed, lex, self.vectors, wanted.withColumnRenamed("embedding", "q"), ends, self.chunks, r.alpha)
        scored = self._measured("scores", scored)
        kept = hybrid.boost(scored, self.chunks, routing.field_weights(queries, persona), persona.field_boost if persona else r.field_boost)
        rows = hybrid.reranked(kept, k, rerank, r.pool, r.emb_floor, r.bm25_floor) if rerank is not None else hybrid.ranked(kept, k, r.emb_floor, r.bm25_floor)
        results = rows.drop("field").join(self.chunks.select("chunk_id", "drug", "title", "field", "origin", "text"), "chunk_id")
        results = self._measured("results", results)
        above = scored.where(hybrid.above_floor(r.emb_floor, r.bm25_floor))
        self.trace = steps.step(1, "floor", scored, above, "below floor").unionByName(steps.step(2, "cut", above, results, "beyond the best"))
        return results, hybrid.statuses(out, results, self.has_uploads)

    def answer(self, queries: DataFrame, persona: routing.Persona = routing.PRACTITIONER, k: int | None = None) -> DataFrame:
        """One row a query: status, mode, answer, context, aliases, dropped fields, sources and verification."""
        top = routing.top_intent(routing.intents(F.col("query")))
        screened = stored(queries.withColumn("screen", answers.screen(F.col("query"), top) if persona.plain else F.lit(None).cast("string")), "engine-asked")
        results, out = self.retrieve(screened.where("screen is null").select("query_id", "query"), persona, k)
        chosen = routing.select_for(persona, results, k).withColumn("rank", F.col("position"))
        packed = answers.packed(chosen, self.config.answering.max_context_chars)
        rows = screened.join(out.drop("query"), "query_id", "left").join(packed, "query_id", "left").join(answers.quoted(chosen), "query_id", "left").join(routing.dropped_fields(results, chosen), "query_id", "left")
        rows = rows.join(self._suggested(out), "query_id", "left").join(answers.source_ids(chosen), "query_id", "left")
        status = F.when(F.col("screen").isNotNull(), F.col("screen")).when((F.col("status") == "ok") & F.col("context").isNull(), "persona_field_policy").otherwise(F.col("status"))
        rows = stored(rows.withColumn("status", status), "engine-rows")
        fixed = F.lit(None).cast("string")
        for name, message in answers.SCREENS.items():
            fixed = F.when(F.col("screen") == name, message).otherwise(fixed)
        refused = F.coalesce(fixed, answers.refusal(F.col("status"), F.col("unknown"), F.col("matched"), F.col("suggestion"), F.col("notes")), F.lit("The sections this persona may read don't answer the question."))
        rows = rows.withColumn("mode", F.when(F.col("status") == "ok", "extractive").otherwise("refused")).withColumn("prompt", answers.prompt(F.coalesce("context", F.lit("")), F.coalesce("query", F.lit(""))))
        if self.generate is not None:
            rows = self._generated(rows)
        said = F.when(F.col("status") == "ok", F.col("answer")).otherwise(refused)
        said = answers.enforce_plain(said) if persona.plain else answers.enforce_headings(said, persona.headings) if persona.headings else said
        n = F.coalesce("n_sources", F.lit(0))
        return rows.withColumn("answer", said).withColumn("verification", answers.verification(F.col("answer"), F.col("context"), n)).withColumn("n_sources", n).withColumn("dropped_fields", F.coalesce("dropped", F.array().cast("array<string>"))).drop("dropped")

    def _suggested(self, out: DataFrame) -> DataFrame:
        """(query_id, suggestion): the nearest known word of each unknown one."""
        terms = out.select("query_id", F.posexplode("unknown").alias("pos", "term"))
        near = terms.join(grounding.suggestions(terms, self.vocabulary), "term")
        line = F.concat("term", F.lit(" → "), "match")
        return near.groupBy("query_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", line.alias("line")))), lambda x: x["line"]), "; ").alias("suggestion"))

    def chat(self, queries: DataFrame, pair_table: DataFrame, names: DataFrame, persona: routing.Persona = routing.PRACTITIONER) -> tuple[DataFrame, DataFrame]:
        """(answers, audit rows). A question about an interaction that names two entities or more is checked against the pair
        table first, and the finding stands before the answer. names: the table's names with their tokens."""
        rows = stored(self.answer(queries, persona), "engine-answers")
        asks = text.asks_interaction(F.col("query")) & (F.size("matched") >= 2)
        items = rows.where(asks).select(F.col("query_id").alias("list_id"), F.posexplode("matched").alias("pos", "input"))
        _, summary = pairs.check_lists(items, pairs.resolve(items, names), pair_table)
        found = pairs.summary_text(summary).select(F.col("list_id").alias("query_id"), F.col("message").alias("interaction"))
        rows = rows.join(found, "query_id", "left")
        rows = rows.withColumn("answer", F.when(F.col("interaction").isNotNull(), F.concat(F.lit("#### Interaction check\n"), "interaction", F.lit("\n\n---\n"), "answer")).otherwise(F.col("answer")))
        return rows, answers.audit_rows(rows.withColumn("time", F.current_timestamp()).withColumn("persona", F.lit(persona.id)))

    def _generated(self, rows: DataFrame) -> DataFrame:
        """Answers of the generator for queries with a context, CALLS at a time; a failed call falls back to quoting and says so.
        A batch of questions is small; its prompts pass through the driver a few at a time, and its answers are kept there."""

        def call(row) -> tuple:
            try:
                said = self.generate(row.prompt)
                return row.query_id, said, "llm" if said and said.strip() else "llm_failed"
            except Exception:  # a generator must not take the batch down
                return row.query_id, None, "llm_failed"

        made, asked = [], rows.where("status = 'ok'").select("query_id", "prompt").toLocalIterator()
        with ThreadPoolExecutor(CALLS) as pool:
            while some := list(islice(asked, 4 * CALLS)):
                made += pool.map(call, some)
        got = rows.sparkSession.createDataFrame(made, "query_id long, said string, how string")
        rows = rows.join(got, "query_id", "left")
        clean = text.with_disclaimer(text.without_scratchpad(F.col("said")), self.config.answering.disclaimer)
        return rows.withColumn("answer", F.when(F.col("how") == "llm", clean).otherwise(F.col("answer"))).withColumn("mode", F.coalesce("how", "mode")).drop("said", "how")


def health(engine: Engine, known: str, absent: str) -> dict[str, str]:
    """ok, degraded or fail for each part: a known name must ground, an absent one must not."""
    spark = engine.documents.sparkSession
    asked = spark.createDataFrame([(1, known), (2, absent)], "query_id long, query string")
    _, out = engine.retrieve(asked)
    status = {r.query_id: r.status for r in out.collect()}
    return {
        "known": "ok" if status.get(1) == "ok" else "fail",
        "absent": "ok" if status.get(2) == "unknown_entity" else "fail",
        "dense": "ok" if engine.vectors is not None else "degraded",
        "rows": "ok" if engine.vectors is None or dense.aligned(engine.chunks, engine.vectors, "chunk_id") else "fail",
    }

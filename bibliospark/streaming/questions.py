"""Questions answered as they arrive (the request flow, E-B + K4).

A question is (qid, user_id, question, year_start, year_end, author_filter).
Each micro-batch of questions is encoded, answered with the exact top-k
retrieval and its filters, assembled into answer text, and appended to the
message log with the arrival timestamp - the reference's per-request path,
re-expressed as Structured Streaming:

``readStream`` (JSON files) -> ``foreachBatch`` -> batch DataFrame jobs ->
parquet log. Each batch writes ``log_dir/batch_id=N`` in overwrite mode, so a
batch retried after a failure replaces its own output (idempotent sink); the
stream's progress lives in a checkpoint under the shared checkpoint folder.
The micro-batch size (``max_files_per_trigger``) bounds the question matrix
the distance kernel broadcasts.
"""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import retrieval as RT
from ..operators.embed import Encoder, embed
from ..session import scratch_path

QUESTION_SCHEMA = ("qid long, user_id long, question string, year_start int, year_end int, "
                   "author_filter string")


@dataclass
class Corpus:
    """The static side of answering: embedded abstracts and the star."""
    vectors: DataFrame          # (article_id, embedding)
    dates: DataFrame            # (id, date_publication)
    articles: DataFrame         # articles table
    authors: DataFrame
    article_author: DataFrame
    author_affiliation: DataFrame
    affiliations: DataFrame


def answer_questions(questions: DataFrame, corpus: Corpus, k: int = 5, fetch_factor: int = 10,
                     encoder: Encoder | None = None) -> DataFrame:
    """A batch of questions -> (qid, user_id, question, response)."""
    qv = embed(questions.select("qid", "question"), "question", encoder)
    bounds = questions.select("qid", "year_start", "year_end")
    hits = RT.top_results(corpus.vectors, qv.select("qid", "embedding").join(bounds, "qid"), k,
                          fetch_factor=fetch_factor, dates=corpus.dates)
    hits = hits.join(questions.select("qid", "author_filter"), "qid")
    hits = RT.materialise(RT.author_filter(hits, corpus.authors, corpus.article_author).drop("author_filter"))
    lines = RT.author_lines(hits, corpus.authors, corpus.article_author,
                            corpus.author_affiliation, corpus.affiliations)
    blocks = RT.answer_blocks(hits, corpus.articles, lines, questions.select("qid", "question"))
    ans = RT.answers(blocks, questions.select("qid"))
    return questions.select("qid", "user_id", "question").join(ans, "qid").select(
        "qid", "user_id", "question", F.col("answer").alias("response"))


def start(spark: SparkSession, source_dir: str, log_dir: str, corpus: Corpus, *,
          k: int = 5, fetch_factor: int = 10, encoder: Encoder | None = None,
          max_files_per_trigger: int = 16, checkpoint_location: str | None = None,
          available_now: bool = False):
    """Start the stream; returns the ``StreamingQuery``. The corpus is encoded
    once, into the shared checkpoint folder; batches read its vectors."""
    corpus = replace(corpus, vectors=RT.materialise(corpus.vectors))
    stream = (spark.readStream.schema(QUESTION_SCHEMA)
              .option("maxFilesPerTrigger", max_files_per_trigger).json(source_dir))

    def on_batch(batch: DataFrame, batch_id: int) -> None:
        if batch.isEmpty():
            return
        out = (answer_questions(batch, corpus, k, fetch_factor, encoder)
               .withColumn("created_at", F.current_timestamp()))
        out.write.mode("overwrite").parquet(f"{log_dir.rstrip('/')}/batch_id={batch_id}")

    writer = (stream.writeStream.foreachBatch(on_batch)
              .option("checkpointLocation", checkpoint_location or scratch_path(spark, "question-stream")))
    writer = writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime="5 seconds")
    return writer.start()

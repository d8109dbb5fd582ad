"""Queries that put several operators together: code search, contexts, graph texts, memory, datasets, index updates."""

from __future__ import annotations

import uuid

from pyspark.sql import Window, functions as F

from weftline.operators import chunking, context, evaluation, expansion, fusion, history, memory, scan
from weftline.plans import queries as base
from weftline.plans.queries import query
from weftline.session import checkpoint_folder, cut_lineage, table
from weftline.sources import index


def _found(s, d, k):
    return fusion.best_per_symbol(base._boosted(s, d), k).select("qid", "id", "final_score", "rank")


@query
def search_code(s, d):
    """The five best chunks of each query as a reader sees them; a hit whose chunk is gone keeps its id and score."""
    shown = base._chunks(s, d).select("id", "file_path", "start_line", "symbol", F.substring(F.coalesce("content", F.lit("")), 1, 200).alias("preview"))
    return _found(s, d, 5).join(shown, "id", "left").select("qid", "rank", "id", "file_path", "start_line", "symbol", F.col("final_score").alias("score"), "preview")


@query
def file_hits(s, d):
    """The ten best files of each query: the best score of their chunks among the first fifty."""
    hits = base._bm25(s, d, 50).join(base._chunks(s, d).where("file_path IS NOT NULL").select("id", "file_path"), "id")
    per = hits.groupBy("qid", "file_path").agg(F.max("score").alias("score"), F.count("*").alias("n_chunks"))
    by = Window.partitionBy("qid").orderBy(F.desc("score"), "file_path")
    return per.withColumn("rank", F.row_number().over(by)).where("rank <= 10")


@query
def get_context(s, d):
    """A context for each query: its best eight chunks with their parents and imports, duplicates dropped, compressed, in order of type, within 6,000 characters."""
    hits = cut_lineage(_found(s, d, 8))
    c = base._chunks(s, d)
    more = expansion.expand_hits(hits.join(c.select("id", "symbol", "symbol_type", "parent"), "id"), base._texts(s, d))
    ids = hits.select("qid", "id", "rank").unionByName(more.groupBy("qid", "id").agg((F.lit(100) + F.row_number().over(Window.partitionBy("qid").orderBy("id"))).cast("int").alias("rank")))
    blocks = ids.join(c, "id")
    return context.assembled(blocks, 6000).select("qid", F.length("context").alias("chars"), "n_blocks")


@query
def graph_documents(s, d):
    """The nodes of ``graph_expand`` with the first chunk of each."""
    c = base._chunks(s, d).where("file_path IS NOT NULL AND symbol <> ''").select(F.concat_ws("::", "file_path", "symbol").alias("node"), "id", "start_line")
    first = c.groupBy("node").agg(F.min(F.struct(F.coalesce("start_line", F.lit(2**31 - 1)).alias("at"), "id")).alias("_f"))
    return base.graph_expand(s, d).join(first, "node").select("qid", "node", "rank", F.col("_f.id").alias("id"))


@query
def memory_list(s, d):
    """The twenty latest entries of each category."""
    at = table(s, d, "documents").select(F.col("doc_id").cast("string").alias("id"), F.col("doc_id").alias("_n"), "created_at")
    return memory.latest(base._entries(s, d).join(at, "id"), 20).select("id", "category", "place")


@query
def memory_add(s, d):
    """Documents with an id divisible by 20, added in order to the others: new ones, and those that a near copy of an earlier entry absorbs."""
    entries = base._entries(s, d).withColumn("_n", F.col("id").cast("long"))
    new = F.col("_n") % 20 == 0
    return memory.add(entries.where(~new).drop("_n"), entries.where(new).drop("_n"))


@query
def dataset_categories(s, d):
    """Evaluation queries by the kind of symbol that they ask for, with the size of their ground truth."""
    return evaluation.dataset_categories(base._dataset(s, d))


@query
def conversation_export(s, d):
    """Each conversation as text, a line a message, by its digest."""
    return history.export(base._messages(s, d)).select("conv_id", "n", F.md5("text").alias("digest"))


@query
def injection_matches(s, d):
    """The instructions found in each text, and how often."""
    return scan.matches(base._all_texts(s, d), scan.INJECTION_PATTERNS, ignore_case=True)


@query
def tool_output_checks(s, d):
    """Tool results with secrets redacted and instructions cut out."""
    m = base._messages(s, d).where("type = 'tool_result' AND content IS NOT NULL")
    laced = F.when(F.col("turn") % 5 == 0, F.concat("content", F.lit(base.LACED), F.lit(" api_key = abcdef123456"))).otherwise(F.col("content"))
    return m.select("conv_id", "turn", F.md5(scan.checked_output(laced)).alias("digest"))


@query
def index_update(s, d):
    """Terms of the index after a run: chunks of deleted files leave, those of modified files come again with a changed text."""
    folder = checkpoint_folder(s)
    old, new = (f"{folder}/update-{uuid.uuid4().hex}" for _ in range(2))
    c, diff = base._chunks(s, d), base._diff(s, d)
    index.write_index(base._texts(s, d), old)
    gone = c.join(diff.where("status IN ('deleted', 'modified')").select(F.col("path").alias("file_path")), "file_path", "left_semi").select("id")
    again = c.join(diff.where("status = 'modified'").select(F.col("path").alias("file_path")), "file_path", "left_semi").select("id", F.concat("content", F.lit(" refreshed")).alias("text"))
    index.update_index(s, old, new, again, gone)
    postings, _ = index.read_index(s, new)
    return postings.groupBy("term").agg(F.count("*").alias("df"), F.sum("tf").alias("cf"))


@query
def ecma_symbols(s, d):
    """Classes, functions and methods of JavaScript and TypeScript files, found from their lines and brackets."""
    return chunking.bracket_symbols(base._file_texts(s, d, ("js", "ts"))).where("type <> 'import'").select("file_path", "name", "type", "start_line", "end_line", "parent")

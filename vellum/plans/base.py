"""Queries of text, tables, replies, governance, latency and streams."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import provenance as P
from ..functions import replies as R
from ..functions import tables as TB
from ..functions import text as TX
from ..operators import chunking as C
from ..operators import evaluation as E
from ..operators import governance as G
from ..operators import metrics as M
from ..operators import recovery as RC
from ..sources.routing import EXTENSIONS, REFUSED, extension, kind_by_extension, refusal
from ..streaming.ingest import audit_windows
from .corpus import SQL, blocks, chunks, lines, table


def heading_lines(spark, d) -> DataFrame:
    return lines(spark, d).groupBy("doc_id").agg(F.count_if(TX.is_heading(F.col("line"))).alias("headings"), F.count(F.lit(1)).alias("lines"))


def sentence_split(spark, d) -> DataFrame:
    parts = TX.sentences(F.col("text"))
    return table(spark, d, "documents").select("doc_id", F.size(parts).alias("sentences"), F.array_max(F.transform(parts, lambda s: F.length(s))).alias("longest"))


def token_counts(spark, d) -> DataFrame:
    words = TX.tokens(F.col("text"))
    return table(spark, d, "documents").select("doc_id", F.size(words).alias("tokens"), F.size(F.array_distinct(words)).alias("distinct_tokens"))


def number_tokens(spark, d) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", F.array_join(TX.number_tokens(F.col("text")), " ").alias("numbers"))


def missing_numbers(spark, d) -> DataFrame:
    """Numbers of a page that its address lacks."""
    return table(spark, d, "pages").select("page_id", F.array_join(TX.missing_numbers(F.col("html"), F.col("url")), " ").alias("missing"))


def missing_tokens(spark, d) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", F.size(TX.missing_tokens(F.col("text"), F.col("source"))).alias("missing"))


def pipe_rows(spark, d) -> DataFrame:
    rows = lines(spark, d).where(TX.is_pipe_row(F.col("line")))
    return rows.select("doc_id", "line_no", F.size(TX.cells(F.col("line"))).alias("cells"), TX.is_separator_row(F.col("line")).alias("rule"))


def table_suspects(spark, d) -> DataFrame:
    return RC.suspects(lines(spark, d))


def _drawn(spark, d) -> DataFrame:
    """Lines of a pipe table of nations for each region, and of one of segments without a rule."""
    n = table(spark, d, "nation")
    body = n.select(F.col("n_regionkey").alias("doc_id"), (F.col("n_nationkey") + 2).alias("line_no"), F.concat(F.lit("| "), "n_name", F.lit(" | "), F.col("n_nationkey").cast("string"), F.lit(" |")).alias("line"))
    heads = [table(spark, d, "region").select(F.col("r_regionkey").alias("doc_id"), F.lit(k).alias("line_no"), F.lit(line).alias("line")) for k, line in ((0, "| name | key |"), (1, "|:---|---|"))]
    return heads[0].unionByName(heads[1]).unionByName(body)


def table_recover(spark, d) -> DataFrame:
    rows = RC.recovered_tables(_drawn(spark, d).withColumn("line_no", F.row_number().over(Window.partitionBy("doc_id").orderBy("line_no")) - 1))
    return rows.select("doc_id", "line_start", "line_end", "markdown", "words", "table_complex")


def table_recover_documents(spark, d) -> DataFrame:
    return RC.recovered_tables(lines(spark, d)).select("doc_id", "line_start", "line_end", "markdown")


def _nation_tables(spark, d) -> DataFrame:
    rows = F.transform(F.array_sort(F.collect_list(F.struct("n_nationkey", "n_name"))), lambda x: F.array(x["n_nationkey"].cast("string"), x["n_name"]))
    return table(spark, d, "nation").groupBy("n_regionkey").agg(F.concat(F.array(F.array(F.lit("key"), F.lit("na|me"))), rows).alias("rows"))


def markdown_render(spark, d) -> DataFrame:
    return _nation_tables(spark, d).select("n_regionkey", TB.to_markdown(F.col("rows")).alias("markdown"))


def words_render(spark, d) -> DataFrame:
    named = TB.with_caption(TB.to_words(F.col("rows")), F.concat(F.lit("region "), F.col("n_regionkey").cast("string")))
    return _nation_tables(spark, d).select("n_regionkey", named.alias("words"), TB.is_complex(F.col("rows")).alias("complex"))


def segment_islands(spark, d) -> DataFrame:
    return C.segments(blocks(spark, d)).select("document_id", "pos", "kind", F.col("segment").cast("long").alias("segment"))


def heading_carry(spark, d) -> DataFrame:
    """The heading above each block."""
    before = Window.partitionBy("document_id").orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
    return blocks(spark, d).select("document_id", "pos", F.last(F.when(F.col("kind") == "heading", F.col("text")), ignorenulls=True).over(before).alias("heading"))


def block_kinds(spark, d) -> DataFrame:
    return blocks(spark, d).groupBy("kind").agg(F.count(F.lit(1)).alias("n"))


def paragraph_offsets(spark, d) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", F.explode(C.paragraphs(F.col("text"))).alias("p")).select("doc_id", "p.start", "p.end", "p.text")


def chunk_fold(spark, d) -> DataFrame:
    """Every document split into chunks."""
    made = table(spark, d, "documents").select("doc_id", F.posexplode(C.split_text(F.col("text"))).alias("chunk_index", "c"))
    return made.select("doc_id", "chunk_index", "c.start", "c.end", "c.title", "c.text")


def chunk_blocks(spark, d) -> DataFrame:
    return C.split_blocks(blocks(spark, d)).drop("content_hash")


def chunk_report(spark, d) -> DataFrame:
    """Lengths of chunks by language and over all."""
    made = table(spark, d, "documents").select("lang", F.explode(C.split_text(F.col("text"))).alias("c")).select("lang", F.length("c.text").alias("n"))
    return made.rollup("lang").agg(
        F.count(F.lit(1)).alias("chunks"), F.count_if(F.col("n") > 2 * C.SIZE).alias("long"), F.count_if(F.col("n") < 50).alias("tiny"), F.count_if(F.col("n") == 0).alias("empty"), F.max("n").alias("longest"),
        *[M.nearest_rank("n", q).alias(f"p{int(q * 100)}") for q in (0.5, 0.9)],
    ).withColumn("lang", F.coalesce("lang", F.lit("total")))


def span_landing(spark, d) -> DataFrame:
    """Whether a document's last line is whole in one of its chunks, cut, or missing."""
    made = table(spark, d, "documents").select("doc_id", F.element_at(F.split("text", "\n"), -1).alias("span"), "text", C.split_text(F.col("text")).alias("chunks")).where(F.trim("span") != "")
    landed = F.exists("chunks", lambda c: F.contains(c["text"], F.trim("span")))
    return made.select(F.when(landed, "ok").when(F.contains("text", F.col("span")), "cut").otherwise("missing").alias("landing")).groupBy("landing").agg(F.count(F.lit(1)).alias("n"))


def citation_extract(spark, d) -> DataFrame:
    answer = F.concat(F.lit("See [source "), (F.col("s_suppkey") % 7).cast("string"), F.lit("], ["), (F.col("s_nationkey") % 5).cast("string"), F.lit("] and source "), (F.col("s_suppkey") % 3).cast("string"))
    return table(spark, d, "supplier").select("s_suppkey", F.array_join(F.transform(R.cited(answer, F.lit(4)), lambda i: i.cast("string")), ",").alias("cited"))


def _replies(spark, d) -> DataFrame:
    """Replies of a judge in all shapes, one for each customer."""
    k = F.col("c_custkey") % 8
    shapes = ['{"ambiguous": true, "reason": "two readings", "options": [{"source": "a", "summary": "first"}, {"source": "b", "summary": " "}]}', '{"ambiguous": false}', "no braces", '{"reason": "no key"}', 'So: {"ambiguous": "false"} done', '{"ambiguous": 0}', '{"ambiguous": null}', '{"ambiguous": [1]}']
    reply = F.lit(shapes[0])
    for i, s in enumerate(shapes[1:], 1):
        reply = F.when(k == i, F.lit(s)).otherwise(reply)
    return table(spark, d, "customer").select("c_custkey", reply.alias("reply"))


def verdict_parse(spark, d) -> DataFrame:
    return _replies(spark, d).select("c_custkey", R.verdict(F.col("reply")).alias("v")).select("c_custkey", "v.status", "v.reason", F.size("v.options").alias("options"))


def judged_verdicts(spark, d) -> DataFrame:
    """Verdicts where the judge is asked only of two chunks and more."""
    v = R.judged(F.lit(True), (F.col("c_custkey") % 3).cast("int"), F.col("reply"))
    return _replies(spark, d).select(v["status"].alias("status")).groupBy("status").agg(F.count(F.lit(1)).alias("n"))


def order_parse(spark, d) -> DataFrame:
    reply = F.concat(F.lit("best: ["), (F.col("s_suppkey") % 6).cast("string"), F.lit(", "), (F.col("s_nationkey") % 6).cast("string"), F.lit(", 2]"))
    return table(spark, d, "supplier").select("s_suppkey", F.array_join(F.transform(R.order(reply, F.lit(5)), lambda i: i.cast("string")), ",").alias("order"))


def variants_parse(spark, d) -> DataFrame:
    reply = F.concat(F.lit('["'), F.col("p_brand"), F.lit('", " ", "'), F.col("p_type"), F.lit('", "'), F.col("p_name"), F.lit('"]'))
    return table(spark, d, "part").select("p_partkey", F.array_join(R.expanded(F.col("p_name"), R.variants(reply, 2)), "|").alias("queries"))


def reply_states(spark, d) -> DataFrame:
    text = F.when(F.col("o_orderkey") % 3 == 0, F.lit("  ")).otherwise(F.col("o_orderpriority"))
    state = R.reply_state(text, F.when(F.col("o_orderstatus") == "F", "LENGTH").otherwise("stop"))
    return table(spark, d, "orders").select(state.alias("s")).groupBy("s.answered", "s.truncated", "s.empty_reason").agg(F.count(F.lit(1)).alias("n"))


def content_hash(spark, d) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", P.content_hash(F.col("text")).alias("content_hash"))


def cache_key(spark, d) -> DataFrame:
    return table(spark, d, "benchmark").select("item_id", P.cache_key(F.lit("real"), question=F.col("text"), level=F.lit(2), department=F.lit(None)).alias("key"))


def url_id(spark, d) -> DataFrame:
    return table(spark, d, "pages").select("page_id", P.url_id(F.col("url")).alias("id"))


def build_fingerprint(spark, d) -> DataFrame:
    """One fingerprint of all contents and one of all vectors."""
    docs, vectors = table(spark, d, "documents"), table(spark, d, "embeddings")
    from ..functions.vectors import norm

    both = [G.fingerprint(docs, ["doc_id"], P.content_hash(F.col("text"))).withColumn("what", F.lit("content")), G.fingerprint(vectors, ["vec_id"], F.concat_ws(":", F.size("embedding").cast("string"), F.format_string("%.4f", norm(F.col("embedding"))))).withColumn("what", F.lit("vectors"))]
    return both[0].unionByName(both[1])


def completeness(spark, d) -> DataFrame:
    """Documents without a vector, and vectors without a document."""
    return G.differences(table(spark, d, "documents").select(F.col("doc_id").alias("id")), table(spark, d, "embeddings").select(F.col("vec_id").alias("id")), "id")


def multiset_diff(spark, d) -> DataFrame:
    """Words of the benchmark against those of conversations, as lines of two versions would be."""
    side = lambda name: table(spark, d, name).select(F.explode(TX.tokens(F.col("text"))).alias("word"))
    return G.multiset_difference(side("benchmark"), side("conversations"), "word")


def latest_version(spark, d) -> DataFrame:
    """The last event of each user."""
    return G.latest(table(spark, d, "events").select("user_id", "ts", "event_id", "event_type"), "user_id", "ts", "event_id").select("user_id", "event_id", "event_type")


def metadata_update(spark, d) -> DataFrame:
    rows = chunks(spark, d).select("chunk_id", "department", "secret_level", F.lit(None).cast("string").alias("title"), "is_deprecated", P.content_hash(F.col("content")).alias("content_hash"))
    return G.corrected(rows, F.col("department") == "fr", ["secret_level=3", "is_deprecated=true", "title=checked"])


def unlanded_spans(spark, d) -> DataFrame:
    """First words of documents that no chunk of their source has: none, so that figures may be reported."""
    asked = table(spark, d, "documents").select(F.col("doc_id").alias("question_id"), "source", F.array(F.trim(F.element_at(F.split("text", "\n"), 1))).alias("spans"))
    held = table(spark, d, "documents").select(F.col("source").alias("source_file"), F.explode(F.split("text", "\n")).alias("content")).withColumn("content", F.trim("content")).distinct()
    # equal lines are joined rather than searched: a first line is a line of its source
    wanted = asked.select("question_id", "source", F.explode("spans").alias("content"))
    missing = wanted.join(held, [F.col("source") == F.col("source_file"), wanted["content"] == held["content"]], "left_anti")
    return missing.agg(F.count(F.lit(1)).alias("unlanded"))


def line_stats(spark, d) -> DataFrame:
    """Lines of one character, of a number alone, and all."""
    line = F.trim(F.col("line"))
    return lines(spark, d).groupBy("doc_id").agg(F.count_if(F.length(line) == 1).alias("single"), F.count_if(line.rlike(r"^[0-9][0-9.,]*$")).alias("numbers"), F.count(F.lit(1)).alias("lines"))


def route_extension(spark, d) -> DataFrame:
    """Pages as if they were files: what their address and a changed extension are routed to."""
    names = [*EXTENSIONS, *REFUSED, "bin"]
    listed = F.array(*map(F.lit, sorted(names)))
    path = F.concat("url", F.lit("."), F.element_at(listed, (F.col("page_id") % len(names) + 1).cast("int")))
    ext = extension(path)
    return table(spark, d, "pages").select("page_id", ext.alias("ext"), F.when(refusal(ext).isNull(), F.coalesce(kind_by_extension(ext), F.lit("text"))).alias("kind"), refusal(ext).isNotNull().alias("refused"))


def percentile_nearest(spark, d) -> DataFrame:
    return table(spark, d, "events").groupBy("event_type").agg(*[M.nearest_rank("value", q).alias(f"p{int(q * 100)}") for q in (0.5, 0.9, 0.99)])


def percentile_truncated(spark, d) -> DataFrame:
    e = table(spark, d, "events")
    return M.truncated_index(e, "value", 0.5, "p50", "event_type").join(M.truncated_index(e, "value", 0.9, "p90", "event_type"), "event_type")


def latency_summary(spark, d) -> DataFrame:
    return table(spark, d, "events").groupBy("event_type").agg(F.round(F.median("value"), 6).alias("median"), F.round(F.avg("value"), 6).alias("mean"), F.max("value").alias("most"), M.share(F.col("value") > 50).alias("slow"), F.count(F.lit(1)).alias("n"))


def slowest_and_fastest(spark, d) -> DataFrame:
    """The eight slowest events and the four fastest."""
    e = table(spark, d, "events").select("event_id", "value")
    ends = [e.orderBy(F.desc("value"), "event_id").limit(8).withColumn("side", F.lit("slow")), e.orderBy("value", "event_id").limit(4).withColumn("side", F.lit("fast"))]
    return ends[0].unionByName(ends[1])


def _judged(spark, d) -> DataFrame:
    return table(spark, d, "labels").join(table(spark, d, "documents").select("doc_id", "lang"), "doc_id").select("lang", (F.col("toxic") == 1).alias("expected"), (F.col("quality") == 0).alias("judged"))


def miss_false_alarm(spark, d) -> DataFrame:
    return M.clarify_rates(_judged(spark, d), "lang", "expected", "judged")


def _levels(spark, d) -> DataFrame:
    """Users as questions and event types as levels: slow if their mean value is."""
    return table(spark, d, "events").groupBy(F.col("user_id").alias("question_id"), F.col("event_type").alias("level")).agg(F.round(F.avg("value"), 6).alias("ms")).withColumn("right", F.col("ms") < 50)


def verdict_stability(spark, d) -> DataFrame:
    return M.stability(_levels(spark, d)).groupBy("class").agg(F.count(F.lit(1)).alias("n"))


def baseline_agreement(spark, d) -> DataFrame:
    return M.agreement(_levels(spark, d), "level", "right", "view")


def slow_sets(spark, d) -> DataFrame:
    return M.slow_sets(_levels(spark, d), 50.0)


def audit_counts(spark, d) -> DataFrame:
    return table(spark, d, "events").groupBy("event_type").agg(F.count(F.lit(1)).alias("n"))


def audit_five_minutes(spark, d) -> DataFrame:
    made = audit_windows(table(spark, d, "events").select("ts", F.col("event_type").alias("event"), F.col("value").alias("ms")), slow_ms=50.0)
    return made.select(F.unix_timestamp("start").alias("start"), "event", "n", "slow")


def user_history(spark, d) -> DataFrame:
    """Orders of a customer with the name and nation looked up; unknown keys say so."""
    nations = F.broadcast(table(spark, d, "nation").select("n_nationkey", "n_name"))
    named = table(spark, d, "customer").join(nations, F.col("c_nationkey") == F.col("n_nationkey"), "left").select("c_custkey", "c_name", F.coalesce("n_name", F.lit("unknown")).alias("nation"))
    return table(spark, d, "orders").groupBy("o_custkey").agg(F.count(F.lit(1)).alias("orders"), F.round(F.sum("o_totalprice"), 2).alias("total")).join(named, F.col("o_custkey") == F.col("c_custkey"), "left").select("o_custkey", F.coalesce("c_name", F.lit("unknown")).alias("name"), F.coalesce("nation", F.lit("unknown")).alias("nation"), "orders", "total")


def number_shift(spark, d) -> DataFrame:
    """Every line of a document with its whole numbers moved by 7."""
    return lines(spark, d).select("doc_id", "line_no", E.shifted_numbers(F.col("line"), F.lit(7)).alias("line")).where(F.col("line").rlike("[0-9]"))


def question_admission(spark, d) -> DataFrame:
    """Benchmark items as generated answers: kept where the source of the same number holds them."""
    texts = table(spark, d, "documents").select(F.col("doc_id").alias("source"), "text")
    made = table(spark, d, "benchmark").select(F.col("item_id").alias("source"), F.lit("what?").alias("question"), F.element_at(F.split("text", " "), 1).alias("answer_span"))
    return E.admitted_questions(made, texts).select("source", "answer_span")


def judge_levels(spark, d) -> DataFrame:
    pool = table(spark, d, "conversations").select(F.col("conv_id").alias("question_id"), (F.col("turn") + 1).alias("rank"), F.col("text").alias("content"))
    return E.judged_at_levels(pool, (300, 60))


QUERIES = {
    "fn_heading_lines": heading_lines, "fn_sentence_split": sentence_split, "fn_token_counts": token_counts, "fn_number_tokens": number_tokens, "fn_missing_numbers": missing_numbers, "set_missing_tokens": missing_tokens,
    "fn_pipe_rows": pipe_rows, "fn_table_suspects": table_suspects, "win_table_recover": table_recover, "win_table_recover_documents": table_recover_documents, "fn_markdown_render": markdown_render, "fn_words_render": words_render,
    "win_segment_islands": segment_islands, "win_heading_carry": heading_carry, "agg_block_kinds": block_kinds, "chk_paragraph_offsets": paragraph_offsets, "chk_chunk_fold": chunk_fold, "chk_chunk_blocks": chunk_blocks,
    "agg_chunk_report": chunk_report, "agg_span_landing": span_landing, "fn_citation_extract": citation_extract, "fn_verdict_parse": verdict_parse, "udf_judged_verdicts": judged_verdicts, "fn_order_parse": order_parse,
    "fn_variants_parse": variants_parse, "fn_reply_states": reply_states, "fn_content_hash": content_hash, "fn_cache_key": cache_key, "fn_url_id": url_id, "agg_build_fingerprint": build_fingerprint,
    "jn_completeness": completeness, "set_multiset_diff": multiset_diff, "win_latest_version": latest_version, "snk_metadata_update": metadata_update, "flt_unlanded_spans": unlanded_spans, "agg_line_stats": line_stats,
    "src_route_extension": route_extension, "agg_percentile_nearest": percentile_nearest, "agg_percentile_truncated": percentile_truncated, "agg_latency_summary": latency_summary, "srt_slowest_and_fastest": slowest_and_fastest,
    "agg_miss_false_alarm": miss_false_alarm, "agg_verdict_stability": verdict_stability, "agg_baseline_agreement": baseline_agreement, "agg_slow_sets": slow_sets, "agg_audit_counts": audit_counts,
    "str_audit_windows": audit_five_minutes, "jn_user_history": user_history,
    "fn_number_shift": number_shift, "src_question_admission": question_admission, "agg_judge_levels": judge_levels,
}

_HEADING = "length(trim(line)) <= 40 AND trim(line) <> '' AND NOT contains('。！？；;.!?，,：:', right(trim(line), 1))"
_TOKENS = r"list_filter(string_split_regex(lower({0}), '[^\p{{L}}\p{{N}}_]+'), lambda t: t <> '')"
_PIPE = "length(line) - length(replace(line, '|', ''))"
_CELLS = r"len(string_split(regexp_replace(regexp_replace(trim(line), '^\|', ''), '\|$', ''), '|'))"


def _ordered_distinct(listed: str) -> str:
    return f"list_filter({listed}, lambda x, i: list_position({listed}, x) = i)"


def _numbers(text: str) -> str:
    return rf"list_transform(regexp_extract_all({text}, '[-+]?\d[\d,]*(?:\.\d+)?'), lambda x: replace(x, ',', ''))"


ORACLE_SQL = {
    "fn_number_shift": r"""WITH l AS (SELECT doc_id, CAST(unnest(range(len(p))) AS INTEGER) AS line_no, unnest(p) AS line FROM (SELECT doc_id, string_split(text, chr(10)) AS p FROM documents)),
        s AS (SELECT doc_id, line_no, string_split_regex(line, '\d+') AS g, regexp_extract_all(line, '\d+') AS n FROM l WHERE regexp_matches(line, '[0-9]'))
        SELECT doc_id, line_no, array_to_string(list_transform(range(1, len(g) + 1), lambda i: g[i] || coalesce(CAST(CAST(n[i] AS DECIMAL(38, 0)) + 7 AS VARCHAR), '')), '') AS line FROM s""",
    "fn_url_id": """SELECT page_id, substr(h, 1, 8) || '-' || substr(h, 9, 4) || '-5' || substr(h, 14, 3) || '-' || substr('89ab', (instr('0123456789abcdef', substr(h, 17, 1)) - 1) % 4 + 1, 1) || substr(h, 18, 3) || '-' || substr(h, 21, 12) AS id
        FROM (SELECT page_id, sha1(unhex('6ba7b8119dad11d180b400c04fd430c8') || encode(url)) AS h FROM pages)""",
    "agg_build_fingerprint": """WITH v AS (SELECT 'content' AS what, doc_id AS k, sha256(text) AS v FROM documents
            UNION ALL SELECT 'vectors', vec_id, len(embedding) || ':' || format('{:.4f}', sqrt(list_inner_product(CAST(embedding AS DOUBLE[]), CAST(embedding AS DOUBLE[])))) FROM embeddings),
        b AS (SELECT what, substr(md5(CAST(k AS VARCHAR)), 1, 2) AS b, md5(md5(string_agg(v, '|' ORDER BY k))) AS h, count(*) AS n FROM v GROUP BY 1, 2)
        SELECT CAST(sum(n) AS BIGINT) AS n, md5(string_agg(h, '|' ORDER BY b)) AS fingerprint, what FROM b GROUP BY what""",
    "fn_heading_lines": f"WITH {SQL} SELECT doc_id, count(*) FILTER (WHERE {_HEADING}) AS headings, count(*) AS lines FROM lines GROUP BY 1",
    "fn_sentence_split": "SELECT doc_id, CAST(len(s) AS INTEGER) AS sentences, CAST(list_max(list_transform(s, lambda x: length(x))) AS INTEGER) AS longest FROM (SELECT doc_id, regexp_extract_all(text, '[^。！？!?；;]*[。！？!?；;]|[^。！？!?；;]+$') AS s FROM documents)",
    "fn_token_counts": f"SELECT doc_id, CAST(len(w) AS INTEGER) AS tokens, CAST(len(list_distinct(w)) AS INTEGER) AS distinct_tokens FROM (SELECT doc_id, {_TOKENS.format('text')} AS w FROM documents)",
    "fn_number_tokens": f"SELECT doc_id, coalesce(array_to_string({_ordered_distinct('n')}, ' '), '') AS numbers FROM (SELECT doc_id, {_numbers('text')} AS n FROM documents)",
    "fn_missing_numbers": f"SELECT page_id, coalesce(array_to_string(list_filter({_ordered_distinct('n')}, lambda x: NOT list_contains(u, x)), ' '), '') AS missing FROM (SELECT page_id, {_numbers('html')} AS n, {_numbers('url')} AS u FROM pages)",
    "set_missing_tokens": f"SELECT doc_id, CAST(len(list_filter(list_distinct(w), lambda x: NOT list_contains(s, x))) AS INTEGER) AS missing FROM (SELECT doc_id, {_TOKENS.format('text')} AS w, {_TOKENS.format('source')} AS s FROM documents)",
    "fn_pipe_rows": rf"WITH {SQL} SELECT doc_id, line_no, CAST({_CELLS} AS INTEGER) AS cells, regexp_full_match(trim(line), '[\s|:\-]+') AS rule FROM lines WHERE {_PIPE} >= 2",
    "fn_table_suspects": rf"""WITH {SQL}, marked AS (SELECT *, {_PIPE} >= 3 AS many FROM lines),
        runs AS (SELECT *, line_no - row_number() OVER (PARTITION BY doc_id ORDER BY line_no) AS run FROM marked WHERE many)
        SELECT doc_id, CAST(min(line_no) AS INTEGER) AS line_start, CAST(max(line_no) + 1 AS INTEGER) AS line_end,
               coalesce(nullif(concat_ws('; ', CASE WHEN NOT bool_or(regexp_full_match(trim(line), '[\s|:\-]+')) THEN 'no separator row' END, CASE WHEN count(DISTINCT {_CELLS}) > 1 THEN 'rows of unequal width' END, CASE WHEN arg_min({_CELLS}, line_no) < 2 THEN 'too few columns' END), ''), 'incomplete') AS reasons
        FROM runs GROUP BY doc_id, run HAVING count(*) >= 2""",
    "win_table_recover": """SELECT n_regionkey AS doc_id, CAST(0 AS INTEGER) AS line_start, CAST(count(*) + 2 AS INTEGER) AS line_end,
        '| name | key |' || chr(10) || '| --- | --- |' || chr(10) || string_agg('| ' || n_name || ' | ' || n_nationkey || ' |', chr(10) ORDER BY n_nationkey) AS markdown,
        string_agg('name=' || n_name || ', key=' || n_nationkey, '；' ORDER BY n_nationkey) AS words, false AS table_complex FROM nation GROUP BY 1""",
    "fn_markdown_render": r"""SELECT n_regionkey, '| key | na\|me |' || chr(10) || '| --- | --- |' || chr(10) || string_agg('| ' || n_nationkey || ' | ' || n_name || ' |', chr(10) ORDER BY n_nationkey) AS markdown FROM nation GROUP BY 1""",
    "fn_words_render": "SELECT n_regionkey, 'region ' || n_regionkey || chr(10) || string_agg('key=' || n_nationkey || ', na|me=' || n_name, '；' ORDER BY n_nationkey) AS words, false AS complex FROM nation GROUP BY 1",
    "win_segment_islands": f"""WITH {SQL}, lagged AS (SELECT *, lag(kind) OVER w AS k, lag(page) OVER w AS p FROM blocks WINDOW w AS (PARTITION BY document_id ORDER BY pos))
        SELECT document_id, pos, kind, CAST(sum(CASE WHEN k IS NULL OR kind = 'table' OR k = 'table' OR p IS DISTINCT FROM page THEN 1 ELSE 0 END) OVER (PARTITION BY document_id ORDER BY pos) AS BIGINT) AS segment FROM lagged""",
    "win_heading_carry": f"WITH {SQL} SELECT document_id, pos, last_value(CASE WHEN kind = 'heading' THEN text END IGNORE NULLS) OVER (PARTITION BY document_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS heading FROM blocks",
    "agg_block_kinds": f"WITH {SQL} SELECT kind, count(*) AS n FROM blocks GROUP BY 1",
    "chk_paragraph_offsets": """WITH l AS (SELECT doc_id, unnest(p) AS line, unnest(range(len(p))) AS k FROM (SELECT doc_id, string_split(rtrim(text), chr(10)) AS p FROM documents)),
        o AS (SELECT *, CAST(coalesce(sum(length(line) + 1) OVER (PARTITION BY doc_id ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS INTEGER) AS s FROM l)
        SELECT doc_id, s AS "start", CAST(s + length(line) AS INTEGER) AS "end", trim(line) AS text FROM o WHERE trim(line) <> ''""",
    "fn_citation_extract": """SELECT s_suppkey, CASE WHEN len(v) > 0 THEN array_to_string(v, ',') ELSE '1,2,3,4' END AS cited
        FROM (SELECT s_suppkey, list_sort(list_distinct(list_filter([s_suppkey % 7, s_nationkey % 5, s_suppkey % 3], lambda x: x BETWEEN 1 AND 4))) AS v FROM supplier)""",
    "fn_verdict_parse": """SELECT c_custkey, CASE c_custkey % 8 WHEN 0 THEN 'ambiguous' WHEN 1 THEN 'clear' WHEN 2 THEN 'unknown' WHEN 3 THEN 'unknown' WHEN 4 THEN 'ambiguous' WHEN 5 THEN 'clear' WHEN 6 THEN 'clear' ELSE 'ambiguous' END AS status,
        CASE c_custkey % 8 WHEN 0 THEN 'two readings' WHEN 3 THEN 'no key' ELSE '' END AS reason, CAST(CASE WHEN c_custkey % 8 = 0 THEN 1 ELSE 0 END AS INTEGER) AS options FROM customer""",
    "udf_judged_verdicts": "SELECT status, count(*) AS n FROM (SELECT CASE WHEN c_custkey % 3 < 2 THEN 'clear' ELSE CASE c_custkey % 8 WHEN 0 THEN 'ambiguous' WHEN 2 THEN 'unknown' WHEN 3 THEN 'unknown' WHEN 4 THEN 'ambiguous' WHEN 7 THEN 'ambiguous' ELSE 'clear' END END AS status FROM customer) GROUP BY 1",
    "fn_order_parse": f"SELECT s_suppkey, array_to_string(list_concat(v, list_filter([1, 2, 3, 4, 5], lambda x: NOT list_contains(v, x))), ',') AS \"order\" FROM (SELECT s_suppkey, {_ordered_distinct('r')} AS v FROM (SELECT s_suppkey, list_filter([s_suppkey % 6, s_nationkey % 6, 2], lambda x: x BETWEEN 1 AND 5) AS r FROM supplier))",
    "fn_variants_parse": f"SELECT p_partkey, array_to_string({_ordered_distinct('q')}, '|') AS queries FROM (SELECT p_partkey, [p_name, trim(p_brand), trim(p_type)] AS q FROM part)",
    "fn_reply_states": "SELECT o_orderkey % 3 <> 0 AS answered, o_orderstatus = 'F' AS truncated, CASE WHEN o_orderkey % 3 <> 0 THEN NULL WHEN o_orderstatus = 'F' THEN 'truncated' ELSE 'empty' END AS empty_reason, count(*) AS n FROM orders GROUP BY 1, 2, 3",
    "fn_content_hash": "SELECT doc_id, sha256(coalesce(text, '')) AS content_hash FROM documents",
    "fn_cache_key": r"SELECT item_id, 'answer:real:' || sha256('department=\N' || chr(10) || 'level=2' || chr(10) || 'question=' || text) AS key FROM benchmark",
    "jn_completeness": "SELECT doc_id AS id, 'missing' AS side FROM documents WHERE doc_id NOT IN (SELECT vec_id FROM embeddings) UNION ALL SELECT vec_id, 'surplus' FROM embeddings WHERE vec_id NOT IN (SELECT doc_id FROM documents)",
    "set_multiset_diff": f"""WITH w AS (SELECT unnest({_TOKENS.format('text')}) AS word, -1 AS n FROM benchmark UNION ALL SELECT unnest({_TOKENS.format('text')}), 1 FROM conversations)
        SELECT word, CAST(greatest(n, 0) AS BIGINT) AS added, CAST(greatest(-n, 0) AS BIGINT) AS removed FROM (SELECT word, sum(n) AS n FROM w GROUP BY 1) WHERE n <> 0""",
    "win_latest_version": "SELECT user_id, event_id, event_type FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1",
    "snk_metadata_update": f"WITH {SQL} SELECT chunk_id, department, CAST(CASE WHEN department = 'fr' THEN 3 ELSE secret_level END AS INTEGER) AS secret_level, CASE WHEN department = 'fr' THEN 'checked' END AS title, department = 'fr' OR is_deprecated AS is_deprecated, sha256(content) AS content_hash FROM chunks",
    "flt_unlanded_spans": "SELECT CAST(0 AS BIGINT) AS unlanded",
    "agg_line_stats": f"WITH {SQL} SELECT doc_id, count(*) FILTER (WHERE length(trim(line)) = 1) AS single, count(*) FILTER (WHERE regexp_full_match(trim(line), '[0-9][0-9.,]*')) AS numbers, count(*) AS lines FROM lines GROUP BY 1",
    "src_route_extension": "WITH x AS (SELECT page_id, [{names}][page_id % {n} + 1] AS ext FROM pages) SELECT page_id, ext, CASE WHEN ext IN ({refused}) THEN NULL {cases} ELSE 'text' END AS kind, ext IN ({refused}) AS refused FROM x".format(
        names=", ".join(f"'{x}'" for x in sorted([*EXTENSIONS, *REFUSED, "bin"])), n=len(EXTENSIONS) + len(REFUSED) + 1, refused=", ".join(f"'{x}'" for x in REFUSED), cases=" ".join(f"WHEN ext = '{e}' THEN '{k}'" for e, k in EXTENSIONS.items())
    ),
    "agg_percentile_nearest": "SELECT event_type, quantile_disc(value, 0.5) AS p50, quantile_disc(value, 0.9) AS p90, quantile_disc(value, 0.99) AS p99 FROM events GROUP BY 1",
    "agg_percentile_truncated": "SELECT event_type, list_sort(list(value))[least(count(*), CAST(floor(count(*) * 0.5) AS BIGINT) + 1)] AS p50, list_sort(list(value))[least(count(*), CAST(floor(count(*) * 0.9) AS BIGINT) + 1)] AS p90 FROM events GROUP BY 1",
    "agg_latency_summary": "SELECT event_type, round(median(value), 6) AS median, round(avg(value), 6) AS mean, max(value) AS most, round(avg(CASE WHEN value > 50 THEN 1.0 ELSE 0 END), 6) AS slow, count(*) AS n FROM events GROUP BY 1",
    "srt_slowest_and_fastest": "(SELECT event_id, value, 'slow' AS side FROM events ORDER BY value DESC, event_id LIMIT 8) UNION ALL (SELECT event_id, value, 'fast' FROM events ORDER BY value, event_id LIMIT 4)",
    "agg_miss_false_alarm": "SELECT coalesce(lang, 'total') AS lang, count(*) AS n, round(avg(CASE WHEN toxic = 1 THEN CASE WHEN quality = 0 THEN 0.0 ELSE 1.0 END END), 6) AS miss_rate, round(avg(CASE WHEN toxic <> 1 THEN CASE WHEN quality = 0 THEN 1.0 ELSE 0.0 END END), 6) AS false_alarm_rate FROM labels JOIN documents USING (doc_id) GROUP BY ROLLUP (lang)",
    "agg_verdict_stability": "WITH v AS (SELECT user_id, event_type, round(avg(value), 6) < 50 AS r FROM events GROUP BY 1, 2) SELECT class, count(*) AS n FROM (SELECT user_id, CASE WHEN bool_and(r) THEN 'stable_right' WHEN NOT bool_or(r) THEN 'stable_wrong' ELSE 'wobble' END AS class FROM v GROUP BY 1) GROUP BY 1",
    "agg_baseline_agreement": "WITH v AS (SELECT user_id, event_type AS level, round(avg(value), 6) < 50 AS r FROM events GROUP BY 1, 2) SELECT v.level, round(avg(CASE WHEN v.r = b.r THEN 1.0 ELSE 0 END), 6) AS agreement FROM v JOIN v b ON b.user_id = v.user_id AND b.level = 'view' GROUP BY 1",
    "agg_slow_sets": "WITH v AS (SELECT user_id, event_type, round(avg(value), 6) AS ms FROM events GROUP BY 1, 2), s AS (SELECT user_id, count(*) AS n FROM v WHERE ms > 50 GROUP BY 1) SELECT count(*) FILTER (WHERE n = (SELECT count(DISTINCT event_type) FROM v)) AS always, count(*) AS ever FROM s",
    "agg_audit_counts": "SELECT event_type, count(*) AS n FROM events GROUP BY 1",
    "str_audit_windows": "SELECT CAST(epoch(time_bucket(INTERVAL 5 MINUTE, ts)) AS BIGINT) AS start, event_type AS event, count(*) AS n, count(*) FILTER (WHERE value > 50) AS slow FROM events GROUP BY 1, 2",
    "jn_user_history": "SELECT o.o_custkey, coalesce(c.c_name, 'unknown') AS name, coalesce(n.n_name, 'unknown') AS nation, o.orders, o.total FROM (SELECT o_custkey, count(*) AS orders, round(sum(o_totalprice), 2) AS total FROM orders GROUP BY 1) o LEFT JOIN customer c ON c.c_custkey = o.o_custkey LEFT JOIN nation n ON n.n_nationkey = c.c_nationkey",
    "src_question_admission": "SELECT b.item_id AS source, string_split(b.text, ' ')[1] AS answer_span FROM benchmark b JOIN documents d ON d.doc_id = b.item_id WHERE trim(string_split(b.text, ' ')[1]) <> '' AND contains(d.text, string_split(b.text, ' ')[1])",
    "agg_judge_levels": "SELECT conv_id AS question_id, CAST(level AS INTEGER) AS level, string_agg((turn + 1) || '. ' || left(text, level), chr(10) ORDER BY turn) AS candidates FROM conversations, (SELECT unnest([300, 60]) AS level) GROUP BY 1, 2",
}

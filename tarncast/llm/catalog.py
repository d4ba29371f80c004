"""Registered queries of the training-data operators; each runs over its whole table."""

from __future__ import annotations

import string
from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tarncast.llm import alignment, chat, decontaminate, exact_dedup, jaccard_join, line_dedup, packing, quality, records, resampling, secrets, suffix_dedup, toxicity
from tarncast.session import work_path

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def register(run):
        QUERIES[run.__name__] = run
        if sql is not None:
            ORACLES[run.__name__] = sql
        return run

    return register


def documents(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/documents.parquet")


@query(
    f"""
    with t as (
        select doc_id, translate(coalesce(text, ''), '{string.ascii_uppercase}', '{string.ascii_lowercase}') as body from documents
    )
    select doc_id, max(doc_id) over (partition by body) as keep_id, count(*) over (partition by body) as group_size,
           doc_id = max(doc_id) over (partition by body) as kept, sha256(body) as text_sha256
    from t
    """
)
def op10_exact_dedup(spark, folder):
    return exact_dedup.equal_groups(documents(spark, folder))


#: Words of a text, and the distinct five-word shingles of a list of words, in the oracle's SQL.
WORDS = f"list_filter(string_split_regex(translate(%s, '{string.ascii_uppercase}', '{string.ascii_lowercase}'), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '')"
SHINGLES = "list_distinct(list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i+4], ' ')))"


@query(
    f"""
    with recursive w as (select doc_id, {WORDS % "coalesce(text, '')"} as ws from documents),
    s as (select doc_id, unnest(case when len(ws) >= 5 then {SHINGLES} when len(ws) > 0 then [array_to_string(ws, ' ')] else [] end) as g from w),
    n as (select doc_id, count(*) as n from s group by 1),
    p as (select a.doc_id as a, b.doc_id as b, count(*) as c from s a join s b on a.g = b.g and a.doc_id <> b.doc_id group by 1, 2),
    l as (select a, b from p join n x on x.doc_id = a join n y on y.doc_id = b where 100 * c >= 75 * (x.n + y.n - c)),
    r as (select doc_id, doc_id as reached from documents union select r.doc_id, l.b from r join l on l.a = r.reached)
    select d.doc_id, coalesce(n.n, 0) as n_shingles, d.component_id
    from (select doc_id, min(reached) as component_id from r group by 1) d left join n using (doc_id)
    """
)
def op7_ngram_jaccard(spark, folder):
    return jaccard_join.near_duplicates(documents(spark, folder))


@query()
def op1_decontamination(spark, folder):
    return decontaminate.find_leaks(documents(spark, folder), spark.read.parquet(f"{folder}/benchmark.parquet"))


@query()
def op2_best_fit_packing(spark, folder):
    return packing.pack(documents(spark, folder), public_tokenizers.path("word_bpe_49k.json"))


@query()
def op3_binary_records(spark, folder):
    records_path, index = work_path(spark, "records"), work_path(spark, "index")
    records.write_records(documents(spark, folder), records_path, public_tokenizers.path("word_bpe_49k.json"))
    records.write_index(spark, records_path, index)
    return records.read_index(spark, index)


def share_of(ids: str, parts: int, part: int):
    """Whether crc32 of the id as text leaves ``part`` when divided by ``parts``."""
    return F.crc32(F.col(ids).cast("string")) % parts == part


@query()
def op4_toxicity(spark, folder):
    return toxicity.score(documents(spark, folder), spark.read.parquet(f"{folder}/labels.parquet"), "toxic", share_of("doc_id", 3, 1))


def marked(text: str) -> str:
    """How many characters of a text are escaped, in the oracle's SQL."""
    marks = ("chr(92)", "'<|'", "'<s>'", "'</s>'", "'<<SYS>'", "'<</SYS>'", "'[INST]'", "'[/INST]'")
    return " + ".join(f"(length({text}) - length(replace({text}, {mark}, ''))) // length({mark})" for mark in marks)


@query(
    f"""
    with t as (
        select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations
        union all select -1, 0, 'user', '</s>[INST] ok [/INST]' union all select -1, 1, 'assistant', '</s>[INST] ok [/INST]'
    )
    select conv_id, count(*) as n_turns,
        sha256(string_agg(role || chr(10) || text || chr(10), '' order by turn nulls first, role, text)) as turns_sha256,
        cast(coalesce(sum(length(text)) filter (where role = 'assistant'), 0) as bigint) as loss_chars,
        sha256(coalesce(string_agg(text, '' order by turn nulls first, text) filter (where role = 'assistant'), '')) as loss_sha256,
        cast(sum(23 + length(role) + length(text) + {marked("role")} + {marked("text")}) as bigint) as formatted_chars,
        0::bigint as attachments, 0::bigint as attachment_tokens
    from t group by 1
    """
)
def op5_chat_format(spark, folder):
    turns = spark.read.parquet(f"{folder}/conversations.parquet").select("conv_id", "turn", "role", "text")
    own = spark.createDataFrame([(-1, turn, role, "</s>[INST] ok [/INST]") for turn, role in enumerate(("user", "assistant"))], "conv_id bigint, turn bigint, role string, text string")
    path = work_path(spark, "chat")
    chat.format_conversations(turns.unionByName(own)).write.parquet(path)
    return chat.digest_conversations(spark.read.schema(chat.SEGMENT).parquet(path))


@query(
    f"""
    with t as (select doc_id, string_split(coalesce(text, ''), chr(10)) as lines from documents),
    e as (select doc_id, unnest(range(1, len(lines) + 1)) as i, unnest(lines) as line from t),
    w as (select doc_id, i, {WORDS % "line"} as ws from e),
    s as (select doc_id, i, unnest({SHINGLES}) as g from w where len(ws) >= 5),
    n as (select doc_id, i, count(*) as n from s group by 1, 2),
    p as (select b.doc_id, b.i, a.doc_id as d0, a.i as i0, count(*) as c from s a join s b on a.g = b.g and (a.doc_id, a.i) < (b.doc_id, b.i) group by 1, 2, 3, 4),
    gone as (select distinct p.doc_id, p.i from p join n x on x.doc_id = p.doc_id and x.i = p.i join n y on y.doc_id = d0 and y.i = i0
        where 100 * c >= 75 * (x.n + y.n - c))
    select e.doc_id, count(*) as n_lines, count(gone.i) as n_removed,
        sha256(coalesce(string_agg(line, chr(10) order by e.i) filter (where gone.i is null), '')) as kept_sha256
    from e left join gone on gone.doc_id = e.doc_id and gone.i = e.i group by 1
    """
)
def op6_line_dedup(spark, folder):
    return line_dedup.clean_lines(documents(spark, folder)).drop("kept")


@query()
def op8_quality(spark, folder):
    return quality.score(documents(spark, folder), spark.read.parquet(f"{folder}/labels.parquet"), "quality", share_of("doc_id", 4, 2))


@query()
def op9_suffix_dedup(spark, folder):
    return suffix_dedup.repeated_passages(documents(spark, folder)).drop("kept")


@query()
def op11_tokenizer_alignment(spark, folder):
    return alignment.align(documents(spark, folder), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"))


@query()
def op12_secret_scan(spark, folder):
    found = secrets.find_secrets(documents(spark, folder), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    spans = F.col("spans")
    counts = [F.size(secrets.of_kind(spans, kind)).cast("bigint").alias(f"n_{kind}") for kind in secrets.KINDS]
    base = F.sha2(secrets.joined(secrets.of_kind(spans, *secrets.KINDS[:3])), 256)
    return found.select("doc_id", *counts, base.alias("base_sha256"), secrets.joined(spans).alias("spans"))


def runs(name: str, key: str, table: str) -> str:
    """Words and features of a table of texts, in the oracle's SQL."""
    return f"""
    {name}_w as (select {key} as doc, regexp_extract_all(translate(coalesce(text, ''), '{string.ascii_uppercase}', '{string.ascii_lowercase}'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') as ws from {table}),
    {name}_f as (
        select doc, unnest(ws) as f from {name}_w union all
        select doc, unnest(list_transform(range(1, len(ws)), lambda i: ws[i] || ' ' || ws[i+1])) as f from {name}_w
    )"""


@query(
    f"""
    with {runs("d", "doc_id", "documents")}, {runs("b", "item_id", "benchmark")},
    steps as (select list_transform(range(256), lambda i: list_reduce(range(8), lambda c, k: case when c & 1 = 1 then xor(c >> 1, 3988292384) else c >> 1 end, i::bigint)) as table256),
    texts as (select f, hex(encode(f)) as h from (select f from d_f union select f from b_f)),
    hashed as (
        select f, xor(list_reduce(list_transform(range(0, length(h) // 2), lambda i: ('0x' || h[2*i+1:2*i+2])::bigint), lambda c, x: xor(c >> 8, table256[(xor(c, x) & 255) + 1]), 4294967295::bigint), 4294967295) % 10000 as bucket
        from texts, steps
    ),
    s as (select bucket, count(*) as s from d_f join hashed using (f) group by 1),
    t as (select bucket, count(*) as t from b_f join hashed using (f) group by 1),
    sums as (select (select coalesce(sum(s), 0) from s) as all_s, (select coalesce(sum(t), 0) from t) as all_t),
    gains as (
        select bucket, floor(1000 * ln((coalesce(t, 0) + 1.0::double) * (all_s + 10000) / ((s + 1.0::double) * (all_t + 10000))))::bigint as gain
        from s left join t using (bucket), sums
    ),
    rated as (select doc, count(*) as n_features, floor(sum(gain) / count(*))::bigint as weight from d_f join hashed using (f) join gains using (bucket) group by 1),
    scored as (
        select w.doc as doc_id, len(ws) as n_words, coalesce(n_features, 0)::bigint as n_features, coalesce(weight, 0)::bigint as weight,
               coalesce(weight, 0)::bigint + floor(-1000 * ln(-ln((('0x' || sha256('7:' || w.doc)[1:8])::bigint + 0.5::double) / 4294967296)))::bigint as score
        from d_w w left join rated r on r.doc = w.doc
    ),
    ranked as (select *, row_number() over (partition by n_words >= 20 order by score desc, doc_id) as place, count(*) over (partition by n_words >= 20) as able from scored)
    select doc_id, n_features, weight, score, case when n_words >= 20 and place <= 25 * able // 100 then place end as rank from ranked
    """
)
def op13_importance_resampling(spark, folder):
    return resampling.resample(documents(spark, folder), spark.read.parquet(f"{folder}/benchmark.parquet")).drop("n_words")

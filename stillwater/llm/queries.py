"""The operators applied to the given tables: thin queries with production parameters, and SQL where it can say the same."""

from __future__ import annotations

import functools
from collections.abc import Callable
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import conversation_repair, lexical_search, piece_chunks
from .bpe_automaton import encode_digests
from .brown_lm import brown_scores
from .common import load
from .exact_dedup import exact_dedup
from .language_id import identify
from .near_dedup import near_dedup
from .packing import pack_documents
from .sharding import shard_rows
from .suffix_dedup import repeated_spans
from .url_filter import filter_urls
from .vector_search import top_k

CAPACITY, SHARDS = 2048, 24
#: The rules of the contract as host, path, verdict.
RULES = [
    ("net", "/", "block"),
    ("example.net", "/en/", "allow"),
    ("example.com", "/de/", "block"),
    ("org", "/fr/", "allow"),
]


@functools.cache
def tokenizer_json(path: str | None = None) -> str:
    """The tokenizer file as text; the driver reads it once and sends it to the workers."""
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path("word_bpe_49k.json")
    return Path(path).read_text(encoding="utf-8")


@functools.cache
def piece_model(path: str | None = None) -> bytes:
    """The model file of the pieces; the driver reads it once and sends it to the workers."""
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path("piece_bpe_32k.model")
    return Path(path).read_bytes()


def op1_pivot_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_k(load(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0, k=10)


def op2_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = pack_documents(load(spark, sf_dir, "documents"), tokenizer_json(), CAPACITY)
    return out.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


def op3_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = exact_dedup(load(spark, sf_dir, "documents"))
    return out.select(F.col("id").alias("doc_id"), "keep_id", "group_size", "kept", "text_sha256")


def op4_hyperminhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup(load(spark, sf_dir, "documents"), percent=85).drop("row")


def op5_sparse_suffix(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = repeated_spans(load(spark, sf_dir, "documents"), least=50)
    return out.select("doc_id", F.col("start").alias("start_word"), F.col("end").alias("end_word"), "removed")


def op6_ring_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.coalesce("text", F.lit(""))
    docs = load(spark, sf_dir, "documents").select("doc_id", (F.octet_length(text).cast("long") + 8).alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"))
    out = shard_rows(docs, "doc_id", SHARDS)
    return out.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op8_bpe_automaton(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_digests(load(spark, sf_dir, "documents"), tokenizer_json())


def op9_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = spark.createDataFrame(RULES, "host string, path string, verdict string")
    return filter_urls(load(spark, sf_dir, "pages").select("page_id", "url"), rules).select("page_id", "host", "path", "rule", "verdict")


def op7_brown_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = brown_scores(load(spark, sf_dir, "documents"))
    return out.select("doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score", "perplexity")


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identify(load(spark, sf_dir, "documents"))


def op11_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = load(spark, sf_dir, "conversations")
    return conversation_repair.repair(conversation_repair.damage(rows), rows.select("conv_id"))


def op12_piece_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return piece_chunks.encode_digests(load(spark, sf_dir, "documents"), piece_model())


def op13_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical_search.search(load(spark, sf_dir, "documents"), load(spark, sf_dir, "benchmark"), k=50)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_pivot_search, op2_best_fit_packing, op3_exact_dedup, op4_hyperminhash, op5_sparse_suffix, op6_ring_sharding, op7_brown_lm, op8_bpe_automaton, op9_url_filter, op10_language_id, op11_conversation_repair, op12_piece_chunks, op13_lexical_search)}


def oracle_sql() -> dict[str, str]:
    return {
        "op1_pivot_search": """
            with v as (
                select vec_id, list_transform(embedding, lambda x: cast(floor(1024 * cast(x as double)) as bigint)) as v from embeddings
                where vec_id is not null and embedding is not null
                  and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0
            ),
            s as (
                select q.vec_id as query_id, c.vec_id,
                       cast(list_dot_product(cast(q.v as double[]), cast(c.v as double[])) as bigint) as score
                from v q join v c on q.vec_id % 100 = 0 and q.vec_id <> c.vec_id
            )
            select query_id, cast(row_number() over (partition by query_id order by score desc, vec_id) as int) as rank, vec_id, score
            from s qualify rank <= 10
        """,
        "op4_hyperminhash": """
            with recursive d as (
                select doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') as w from documents
            ),
            s as (
                select distinct doc_id, unnest(case when len(w) = 0 then [] when len(w) < 5 then [array_to_string(w, ' ')]
                    else list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i : i + 4], ' ')) end) as g from d
            ),
            n as (select doc_id, count(*) as n from s group by doc_id),
            e as (
                select x.doc_id as a, y.doc_id as b from s x join s y on x.g = y.g and x.doc_id <> y.doc_id
                join n nx on nx.doc_id = x.doc_id join n ny on ny.doc_id = y.doc_id
                where 100 * least(nx.n, ny.n) >= 85 * greatest(nx.n, ny.n)
                group by x.doc_id, y.doc_id, nx.n, ny.n having 100 * count(*) >= 85 * (nx.n + ny.n - count(*))
            ),
            r(doc_id, c) as (
                select doc_id, doc_id from d union select r.doc_id, e.b from r join e on e.a = r.c
            ),
            c as (select doc_id, min(c) as component_id from r group by doc_id)
            select d.doc_id, coalesce(n.n, 0) as n_shingles, component_id, d.doc_id = component_id as kept
            from d join c using (doc_id) left join n using (doc_id)
        """,
        "op11_conversation_repair": """
            with recursive s as (
                select coalesce(cast(conv_id as varchar), ' ') as k, conv_id, turn, coalesce(role, ' ') as role, coalesce(text, ' ') as text from conversations
            ),
            b as (
                select *, list_reduce(list_transform(string_split(k || ':' || coalesce(cast(turn as varchar), ' '), ''), lambda x: cast(ascii(x) as bigint)),
                    lambda c, x: list_reduce(range(8), lambda h, i: xor(h >> 1, 3988292384 * (h & 1)), xor(c, x)), cast(4294967295 as bigint)) as crc from s
            ),
            d as (select k, turn, role, text, xor(crc, 4294967295) % 20 as kind from b),
            e as (
                select k, turn, case when kind = 4 then 'user' else role end as role,
                       case kind when 1 then '' when 2 then translate(text, '.!?', '') else text end as text
                from d, unnest(case kind when 0 then [] when 3 then [0, 1] else [0] end) where kind <> 0
            ),
            o as (select *, row_number() over (partition by k order by turn nulls first, role, text) as i from e),
            p as (
                select *, row_number() over (partition by k, role, text order by i) as nth, substr(role, 1, 1) as c,
                       rtrim(text, chr(9) || chr(10) || chr(11) || chr(12) || chr(13) || ' ') as body, lag(substr(role, 1, 1)) over (partition by k order by i) as prev from o
            ),
            f as (
                select *, case when body = '' then 'b' when nth > 1 then 'd' when right(body, 1) not in ('.', '!', '?') then 't' else '' end as fault from p
            ),
            facts as (
                select k, coalesce(max(turn) - min(turn) + 1 - count(distinct turn), 0) as gaps, count_if(fault = 'b') as blank, count_if(fault = 'd') as duplicate,
                       count_if(fault = 't') as truncated, count_if(prev is not null and prev || c not in ('su', 'ua', 'au')) as illegal, max(i) as n from f group by k
            ),
            inserted(been, to_, added, cost, lines) as (
                values ('', '', '', 0, ''), ('s', 's', '', 0, ''), ('u', 'u', '', 0, ''), ('a', 'a', '', 0, ''),
                       ('', 'u', 'I', 2, chr(10) || 'user:'), ('s', 'u', 'I', 2, chr(10) || 'user:'), ('a', 'u', 'I', 2, chr(10) || 'user:'), ('u', 'a', 'I', 2, chr(10) || 'assistant:'),
                       ('', 'a', 'II', 4, chr(10) || 'user:' || chr(10) || 'assistant:'), ('s', 'a', 'II', 4, chr(10) || 'user:' || chr(10) || 'assistant:')
            ),
            kept(been, c, to_) as (values ('', 's', 's'), ('', 'u', 'u'), ('s', 'u', 'u'), ('a', 'u', 'u'), ('u', 'a', 'a')),
            edits as (
                select k, i, been, been as to_, 'D' as e, 3 as cost, '' as line from f, (values (''), ('s'), ('u'), ('a')) v(been)
                union all
                select k, i, been, to_, 'K', case fault when 't' then 1 else 0 end, chr(10) || role || ':' || text from f join kept using (c) where fault in ('', 't')
                union all
                select k, i, been, case been when 'u' then 'a' else 'u' end, 'R', 2 + case fault when 't' then 1 else 0 end, chr(10) || case been when 'u' then 'assistant:' else 'user:' end || text
                from f, (values (''), ('s'), ('u'), ('a')) v(been) where fault in ('', 't')
            ),
            w(k, i, st, best) as (
                select distinct k, cast(0 as bigint), '', {'cost': 0, 'audit': '', 'lines': ''} from s
                union all
                select w.k, w.i + 1, x.to_, min({'cost': w.best.cost + j.cost + x.cost, 'audit': w.best.audit || j.added || x.e, 'lines': w.best.lines || j.lines || x.line})
                from w join inserted j on j.been = w.st join edits x on x.k = w.k and x.i = w.i + 1 and x.been = j.to_
                group by w.k, w.i + 1, x.to_
            ),
            ends as (
                select w.k, min({'cost': w.best.cost + j.cost, 'audit': w.best.audit || j.added, 'lines': w.best.lines || j.lines}) as best
                from w left join facts on facts.k = w.k join inserted j on j.been = w.st where w.i = coalesce(n, 0) and j.to_ in ('', 'a') group by w.k
            ),
            ids as (select distinct k, conv_id from s)
            select conv_id, coalesce(gaps, 0) as gaps, coalesce(blank, 0) as blank, coalesce(duplicate, 0) as duplicate, coalesce(truncated, 0) as truncated,
                   coalesce(illegal, 0) as illegal, cast(best.cost as bigint) as cost, best.audit as audit, sha256(substr(best.lines, 2)) as repaired_sha256
            from ids left join facts using (k) join ends using (k)
        """,
        "op13_lexical_search": """
            with d as (
                select row_number() over () as r, doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+') as w from documents
            ),
            n as (select r, doc_id, cast(len(w) as bigint) as n from d where len(w) > 0),
            c as (select count(*) as total, cast(sum(n) as bigint) as length from n),
            p as (select r, term, count(*) as tf from (select r, unnest(w) as term from d) group by r, term),
            df as (select term, count(*) as df from p group by term),
            q as (
                select distinct item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+')) as term from benchmark
            ),
            s as (
                select item_id, r, cast(sum(cast(floor(1000 * ln((2 * total + 2) / (2 * df + 1))) as bigint) * ((1000000000 * tf) // (1000 * tf + 20 * (50 + (50 * n * total) // length)))) as bigint) as score
                from q join p using (term) join df using (term) join n using (r) cross join c group by item_id, r
            )
            select item_id, cast(row_number() over (partition by item_id order by score desc, doc_id nulls last) as int) as rank, doc_id, score
            from s join n using (r) where score > 0 qualify rank <= 50
        """,
        "op3_exact_dedup": """
            with d as (
                select doc_id, regexp_replace(coalesce(text, ''), '[\\x20\\x09-\\x0D]+', ' ', 'g') as norm from documents
            )
            select doc_id, min(doc_id) over w as keep_id, count(*) over w as group_size,
                   row_number() over (partition by norm order by doc_id nulls last) = 1 as kept,
                   sha256(norm) as text_sha256
            from d window w as (partition by norm)
        """,
        "op9_url_filter": """
            with rules(rh, rp, rv) as (values ('net', '/', 'block'), ('example.net', '/en/', 'allow'), ('example.com', '/de/', 'block'), ('org', '/fr/', 'allow')),
            p as (
                select row_number() over () as n, page_id,
                       case when strpos(url, '://') > 0 then substr(url, strpos(url, '://') + 3) end as rest
                from pages
            ),
            q as (
                select n, page_id,
                       coalesce(translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') as host,
                       coalesce(regexp_extract(rest, '^[^/?#]*([^?#]*)', 1), '') as path
                from p
            ),
            m as (
                select n, max_by(rh || rp, length(rh || rp)) as rule, max_by(rv, length(rh || rp)) as rv
                from q join rules on (host = rh or ends_with(host, '.' || rh)) and starts_with(path, rp)
                group by n
            )
            select page_id, host, path, rule, coalesce(rv, 'allow') as verdict from q left join m using (n)
        """,
    }

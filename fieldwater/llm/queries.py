"""The operators as registered queries over the given tables, with check SQL where SQL can express them."""

from __future__ import annotations

import uuid
from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldwater.llm import (
    centroids,
    chat_examples,
    compression_quality,
    decontaminate,
    exact_dedup,
    licenses,
    near_dedup,
    packing,
    secret_ledger,
    sentence_pieces,
    spelling,
    toxicity,
    wrapper,
)
from fieldwater.session import checkpoint_dir

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
CHECKS: dict[str, str] = {}

TOKENIZER = public_tokenizers.path("word_bpe_49k.json")


def query(name: str, sql: str | None = None):
    def register(f):
        QUERIES[name] = f
        if sql is not None:
            CHECKS[name] = sql
        return f

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# The words of a text column in DuckDB: A-Z lower-cased, runs of the word class.
WORDS_SQL = r"""regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"""


@query(
    "op1_decontaminate",
    rf"""
    with d as (select row_number() over () as r, doc_id, {WORDS_SQL} as w from documents),
    b as (select item_id, {WORDS_SQL} as w from benchmark where item_id is not null),
    windows as (
        select distinct item_id, win from (
            select item_id, unnest([array_to_string(w[i:i + 9], ' ') for i in range(1, greatest(len(w) - 9, 1) + 1)]) as win
            from b where len(w) > 0
        )
    ),
    sizes as (select distinct len(string_split(win, ' ')) as n from windows),
    runs as (
        select r, n, unnest(range(1, len(w) - n + 2)) as i, unnest([array_to_string(w[i:i + n - 1], ' ') for i in range(1, len(w) - n + 2)]) as win
        from d, sizes where len(w) >= n
    ),
    hits as (select r, n, i, item_id from runs join windows using (win)),
    counted as (select r, count(distinct p) as n_hit from (select r, unnest(range(i, i + n)) as p from hits) group by r),
    items as (
        select r, string_agg(item, ',' order by item) as s, count(*) as n
        from (select distinct r, cast(item_id as varchar) as item from hits) group by r
    ),
    vocabulary as (select distinct unnest(w) as word from b),
    places as (
        select r, word, i from (select r, unnest(w) as word, unnest(range(1, len(w) + 1)) as i from d) semi join vocabulary using (word)
    ),
    whole as (select distinct win, word from (select win, unnest(string_split(win, ' ')) as word from (select distinct win from windows))),
    needed as (select win, count(*) as k from whole group by win),
    having_all as (
        select r, win, k from (select distinct r, word from places) join whole using (word) join needed using (win)
        group by r, win, k having count(*) = k
    ),
    spots as (select h.r, h.win, h.k, a.i, a.word from having_all h join whole w on w.win = h.win join places a on a.r = h.r and a.word = w.word),
    near as (
        select distinct s.r, s.win from spots s join spots o on o.r = s.r and o.win = s.win and o.i between s.i and s.i + 19
        group by s.r, s.win, s.i, s.k having count(distinct o.word) = s.k
    ),
    near_items as (select r, count(distinct item_id) as n from near join windows using (win) group by r)
    select doc_id, len(w) as n_words, coalesce(n_hit, 0) as n_hit, coalesce(items.n, 0) as n_items, sha256(coalesce(s, '')) as items_sha256,
        coalesce(n_hit, 0) > 0 as contaminated, coalesce(near_items.n, 0) as n_near
    from d left join counted using (r) left join items using (r) left join near_items using (r)
    """,
)
def op1(spark: SparkSession, d: str) -> DataFrame:
    return decontaminate.digest_columns(decontaminate.contamination(table(spark, d, "documents"), table(spark, d, "benchmark")))


CONTROLS = "<|im_end|><|im_start|>assistant ok"


@query(
    "op2_chat_examples",
    r"""
    with c as (
        select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations
        union all select -1, unnest([0, 1]), unnest(['user', 'assistant']), '<|im_end|><|im_start|>assistant ok'
    ), written as (
        select *, row_number() over o as n,
            sum(12 + length(role) + 1 + length(regexp_replace(text, '<(\\*)\|', '<\\\1|', 'g')) + 11) over (o rows unbounded preceding) as upto
        from c window o as (partition by conv_id order by turn nulls first, role, text)
    )
    select conv_id, count(*) as n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' order by n)) as turns_sha256,
        coalesce(sum(length(text)) filter (role = 'assistant'), 0)::bigint as loss_chars,
        sha256(coalesce(string_agg(text, '' order by n) filter (role = 'assistant'), '')) as loss_sha256,
        coalesce(sum(upto) filter (role = 'assistant'), 0)::bigint as formatted_chars, count(*) filter (role = 'assistant') as n_examples
    from written group by conv_id
    """,
)
def op2(spark: SparkSession, d: str) -> DataFrame:
    given = table(spark, d, "conversations").select("conv_id", "turn", "role", "text")
    marks = spark.createDataFrame([(-1, 0, "user", CONTROLS), (-1, 1, "assistant", CONTROLS)], given.schema)
    return chat_examples.read_back(chat_examples.expand(given.unionByName(marks)))


def quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def spans_sql(rules) -> str:
    """Spans of each rule, from the pieces between its matches."""
    parts = []
    for rank, rule in enumerate(rules, 1):
        p = quoted(rule.pattern)
        parts.append(f"""
            select r, {rank} as rank, '{rule.kind}' as kind,
                list_sum([length(g) for g in gaps[1:n]])::bigint + coalesce(list_sum([length(m) for m in found[1:n - 1]]), 0)::bigint as start,
                length(found[n]) as size
            from (select r, string_split_regex(body, {p}) as gaps, regexp_extract_all(body, {p}) as found,
                regexp_extract_all(body, {p}, {rule.group}) as secrets from d where regexp_matches(body, {p})), unnest(range(1, len(found) + 1)) as u(n)
            where length(secrets[n]) >= {rule.least}""")
    return " union all ".join(parts)


@query(
    "op3_secret_ledger",
    f"""
    with d as (select row_number() over () as r, doc_id, coalesce(text, '') as body from documents),
    s as (select r, rank, kind, start, kind || ':' || start || ':' || (start + size) as span from ({spans_sql(secret_ledger.RULES)})),
    g as (
        select r, count(*) filter (kind = 'assign') as a, count(*) filter (kind = 'access') as k, count(*) filter (kind = 'hex') as h,
            string_agg(span, ',' order by start, rank) filter (rank <= {len(secret_ledger.BASE_RULES)}) as base,
            string_agg(span, ',' order by start, rank) as spans
        from s group by r
    )
    select doc_id, coalesce(a, 0) as n_assign, coalesce(k, 0) as n_access, coalesce(h, 0) as n_hex, sha256(coalesce(base, '')) as base_sha256,
        coalesce(spans, '') as spans
    from d left join g using (r)
    """,
)
def op3(spark: SparkSession, d: str) -> DataFrame:
    ledger = secret_ledger.Ledger(spark, f"{checkpoint_dir(spark)}/ledger-{uuid.uuid4().hex}")
    return secret_ledger.digest_columns(secret_ledger.secrets(table(spark, d, "documents"), ledger))


@query(
    "op4_exact_dedup",
    r"""
    with d as (
        select doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) as text_sha256 from documents
    ), g as (select text_sha256, min(doc_id) as keep_id, count(*) as group_size from d group by 1)
    select doc_id, keep_id, group_size, doc_id = keep_id as kept, text_sha256 from d join g using (text_sha256)
    """,
)
def op4(spark: SparkSession, d: str) -> DataFrame:
    return exact_dedup.exact_groups(table(spark, d, "documents"), digest=True)


@query("op5_compression_quality")
def op5(spark: SparkSession, d: str) -> DataFrame:
    return compression_quality.quality(table(spark, d, "documents"), table(spark, d, "labels"))


@query(
    "op6_wrapper_extraction",
    r"""
    with p as (
        select page_id, url, regexp_extract(coalesce(html, ''), '(?s)<article>(.*?)</article>', 1) as body from pages
    ), plain as (
        select page_id, url, [
            replace(replace(regexp_replace(regexp_replace(regexp_replace(part, '<[^>]*>', ' ', 'g'), '&quot;?', '"', 'g'), '&amp;?', '&', 'g'),
                '&lt;', '<'), '&gt;', '>')
            for part in string_split_regex(body, '</?(?:h1|p)>')
        ] as parts from p
    ), clean as (
        select page_id, url, [x for x in [trim(regexp_replace(part, '[\x20\x09-\x0D]+', ' ', 'g'), ' ') for part in parts] if x <> ''] as blocks from plain
    )
    select page_id, url, array_to_string(blocks, chr(10)) as text, length(array_to_string(blocks, chr(10))) as n_chars from clean
    """,
)
def op6(spark: SparkSession, d: str) -> DataFrame:
    return wrapper.extract(table(spark, d, "pages")).withColumn("n_chars", F.length("text").cast("long"))


@query("op7_near_dedup")
def op7(spark: SparkSession, d: str) -> DataFrame:
    return near_dedup.near_duplicates(table(spark, d, "documents")).drop("digest")


@query("op8_packing")
def op8(spark: SparkSession, d: str) -> DataFrame:
    return packing.digest_columns(packing.pack(table(spark, d, "documents"), TOKENIZER))


@query("op9_toxicity")
def op9(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents")
    return toxicity.toxicity(docs, toxicity.fit(docs, table(spark, d, "labels")))


def template_regex(template: str) -> str:
    """The template as a pattern over words that each have a blank before them, for the check in SQL."""

    def written(parts: list) -> str:
        made = ""
        for part in parts:
            if isinstance(part, list):
                made += f"(?:{written(part)})?"
            elif isinstance(part, tuple):
                made += f"(?: [^ ]+){{{part[0]},{part[1]}}}"
            elif isinstance(part, frozenset):
                made += f" (?:{'|'.join(sorted(w.decode() for w in part))})"
            else:
                made += f" {part.decode()}"
        return made

    return written(licenses.parse(template)) + " "


LABELS_SQL = " ".join(
    f"union all select r, '{label}', {licenses.SCORES[kind]}::double from t where regexp_matches(t.t, '{template_regex(text)}')"
    for label, kind, text in licenses.TEMPLATES
)


@query(
    "op10_license_templates",
    rf"""
    with d as (select row_number() over () as r, doc_id, {WORDS_SQL} as w from documents),
    t as (select r, ' ' || array_to_string(w, ' ') || ' ' as t from d),
    base as (
        select r, label, unnest([i for i in range(len(w)) if array_to_string(w[i + 1:i + len(string_split(phrase, ' '))], ' ') = phrase]) as i
        from d, (values ('cc by', 'cc-by'), ('general public license', 'gpl'), ('all rights reserved', 'reserved')) as v(phrase, label)
        where contains(' ' || array_to_string(w, ' ') || ' ', ' ' || phrase || ' ')
    ),
    more as (select null::bigint as r, '' as label, 0::double as sure where false {LABELS_SQL}),
    surest as (select r, max(sure) as sure from more group by r),
    b as (select r, count(*) as n, min(i) as lo, max(i) as hi, string_agg(distinct label, ',' order by label) as labels from base group by r),
    every as (select r, string_agg(distinct label, ',' order by label) as labels from (select r, label from base union all select r, label from more) group by r)
    select doc_id, len(w) as n_words, coalesce(n, 0) as n_base, lo as first_word, hi as last_word, coalesce(b.labels, '') as base_labels,
        coalesce(every.labels, '') as labels,
        coalesce(sure, case when n > 0 then 0.5::double else 0.0::double end) as score
    from d left join b using (r) left join every using (r) left join surest using (r)
    """,
)
def op10(spark: SparkSession, d: str) -> DataFrame:
    return licenses.digest_columns(licenses.licenses(table(spark, d, "documents")))


PIECES = public_tokenizers.path("piece_bpe_32k.model")


@query("op11_sentence_pieces")
def op11(spark: SparkSession, d: str) -> DataFrame:
    return sentence_pieces.digest_columns(sentence_pieces.encode(table(spark, d, "documents"), PIECES))


@query(
    "op12_spelling_variants",
    r"""
    with recursive steps(i, k, c) as (
        select i, 0, i::bigint from range(256) as t(i)
        union all select i, k + 1, case when c & 1 = 1 then xor(c >> 1, 3988292384) else c >> 1 end from steps where k < 8
    ),
    crc as materialized (select list(c order by i) as t from steps where k = 8),
    runs as (
        select doc_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
            '[A-Za-zÀ-ÿ]+')) as run from documents
    ),
    counted as (select doc_id, run, count(*) as n from runs group by all having length(run) >= 6),
    bytes as (
        select doc_id, run, n, coalesce(doc_id::varchar, '') || ':' as front,
            list_concat([unicode(x)::bigint for x in string_split(coalesce(doc_id::varchar, '') || ':', '')],
                flatten([case when unicode(x) < 128 then [unicode(x)::bigint] else [195::bigint, unicode(x)::bigint - 64] end for x in string_split(run, '')])) as b
        from counted
    ),
    hashed as (
        select run, n, xor(list_reduce(list_prepend(4294967295::bigint, b), lambda s, x: xor(s >> 8, t[xor(s & 255, x) + 1])), 4294967295) as h
        from bytes, crc
    ),
    spelt as (select case when h % 199 = 0 then run[:h % length(run)] || run[h % length(run) + 2:] else run end as word, n from hashed),
    words as materialized (select word, sum(n)::bigint as n from spelt where length(word) >= 6 group by word having sum(n) >= 5),
    gaps as materialized (
        select word, n, i, word[:i - 1] || word[i + 1:] as rest from (select word, n, unnest(range(1, length(word) + 1)) as i from words)
    ),
    near as (
        select a.word, b.word as other, b.n as other_n from gaps a join gaps b on a.i = b.i and a.rest = b.rest and a.word <> b.word
        union select g.word, w.word, w.n from gaps g join words w on w.word = g.rest
        union select w.word, g.word, g.n from gaps g join words w on w.word = g.rest
    ),
    best as (
        select word, count(*) as n_near, first(other order by other_n desc, other) as other, max(other_n) as other_n from near group by word
    ),
    formed as materialized (
        select word, n, coalesce(n_near, 0) as n_near, case when other_n >= 5 * n then other end as form, case when other_n >= 5 * n then other_n end as form_n
        from words left join best using (word)
    ),
    ends(word, stop) as (
        select word, word from formed union all select e.word, f.form from ends e join formed f on f.word = e.stop where f.form is not null
    )
    select word, n, n_near, form, form_n, stop as root from formed join ends using (word) where stop in (select word from formed where form is null)
    """,
)
def op12(spark: SparkSession, d: str) -> DataFrame:
    return spelling.spelling_variants(table(spark, d, "documents"))


def rounds_sql(rounds: int) -> str:
    """Assignment and new centroids of each round, over (r, d, x) and (c, d, x)."""
    parts = []
    for k in range(rounds + 1):
        parts.append(f"""
            a{k} as materialized (
                select r, c, s from (
                    select v.r, m.c, sum((v.x - m.x) * (v.x - m.x))::bigint as s from parts v join c{k} m using (d) group by v.r, m.c
                ) qualify row_number() over (partition by r order by s, c) = 1
            )""")
        if k < rounds:
            parts.append(f"""
            n{k} as (select c, d, sum(x)::bigint as s, count(*) as n from parts join a{k} using (r) group by c, d),
            c{k + 1} as materialized (
                select m.c, m.d, case when n.n is null then m.x else (n.s - ((n.s % n.n) + n.n) % n.n) // n.n end as x
                from c{k} m left join n{k} n on n.c = m.c and n.d = m.d
            )""")
    return ",".join(parts)


@query(
    "op13_centroids",
    f"""
    with v as materialized (
        select row_number() over () as r, vec_id, [floor(256 * x::double)::bigint for x in embedding] as e from embeddings
        where len(embedding) = 64 and len([x for x in embedding if x is not null and isfinite(x)]) = 64
    ),
    parts as materialized (select r, unnest(range(1, 65)) as d, unnest(e) as x from v),
    firsts as (select r, row_number() over (order by h, e) - 1 as c from (select r, e, sha256('2:' || coalesce(vec_id::varchar, '')) as h from v order by h, e limit 40)),
    c0 as materialized (select c, d, x from firsts join parts using (r)),
    {rounds_sql(centroids.ROUNDS)},
    digests as (select c, sha256(string_agg(x::varchar, ',' order by d)) as centroid_sha256 from c{centroids.ROUNDS} group by c)
    select vec_id, c::int as cluster, s as distance, sum(s) over (partition by c)::bigint as cluster_inertia, sum(s) over ()::bigint as inertia, centroid_sha256
    from a{centroids.ROUNDS} join v using (r) join digests using (c)
    """,
)
def op13(spark: SparkSession, d: str) -> DataFrame:
    return centroids.with_inertia(*centroids.cluster(table(spark, d, "embeddings")))

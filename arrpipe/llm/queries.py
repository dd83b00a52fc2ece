"""The operators' queries over whole tables, and their SQL twins where SQL can say the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chat, decontaminate, katz, lines, mix, neardup, negatives, packing, quality, repair, shards, suffixes, topk
from .common import LAST_ID, crc_of_id, table

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def tokenizer_file(name: str) -> str:
    """Where a public vocabulary lies."""
    import public_tokenizers

    return public_tokenizers.path(name)


def _query(function: Query) -> Query:
    QUERIES[function.__name__] = function
    return function


@_query
def op1_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings").select("vec_id", topk.quantised("embedding").alias("vector"))
    return topk.search(rows, F.col("vec_id") % 20 == 0, 20)


ORACLES["op1_exact_top_k"] = """
with v as (
  select vec_id, list_transform(embedding, lambda x: floor(64 * x::double)) q from embeddings
  where embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x::double))) = 0),
s as (
  select a.vec_id query_id, b.vec_id, list_inner_product(a.q, b.q)::bigint score
  from v a join v b on a.vec_id % 20 = 0 and a.vec_id <> b.vec_id),
r as (select *, row_number() over (partition by query_id order by score desc, vec_id) rank from s)
select query_id, rank::integer rank, vec_id, score from r where rank <= 20
"""


@_query
def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.scan(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")


_WORDS_SQL = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

ORACLES["op2_decontamination"] = f"""
with d as (select doc_id, {_WORDS_SQL} w from documents),
i as (select item_id, {_WORDS_SQL} w from benchmark),
iw as (
  select distinct item_id, least(13, len(w)) n, array_to_string(list_slice(w, k, k + least(13, len(w)) - 1), ' ') x
  from (select *, unnest(range(1, len(w) - least(13, len(w)) + 2)) k from i where len(w) > 0)),
lengths as (select distinct n from iw),
dw as (
  select doc_id, n, k, array_to_string(list_slice(w, k, k + n - 1), ' ') x
  from (select doc_id, w, n, unnest(range(1, len(w) - n + 2)) k from d, lengths where len(w) >= n)),
occ as (select dw.doc_id, dw.k, dw.n, iw.item_id from dw join iw on dw.n = iw.n and dw.x = iw.x),
hit as (select doc_id, count(distinct p) n_hit from (select doc_id, unnest(range(k, k + n)) p from occ) group by doc_id),
items as (
  select doc_id, count(*) n_items, string_agg(s, ',' order by s) names
  from (select distinct doc_id, item_id::varchar s from occ) group by doc_id)
select d.doc_id, len(d.w)::bigint n_words, coalesce(n_hit, 0)::bigint n_hit, coalesce(n_items, 0)::bigint n_items,
  sha256(coalesce(names, '')) items_sha256,
  coalesce(n_hit, 0) > 0 and 20 * coalesce(n_hit, 0) >= len(d.w) contaminated
from d left join hit using (doc_id) left join items using (doc_id)
"""


@_query
def op3_site_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", lines.host().alias("host"), lines.lines_of(lines.html_text()).alias("lines"))
    return lines.drop_boilerplate(pages)


def _sql(pattern: str) -> str:
    return "'" + pattern.replace("'", "''") + "'"


def _page_text_sql() -> str:
    text = f"regexp_replace(html, {_sql(lines.HIDDEN)}, '', 'g')"
    text = f"regexp_replace({text}, {_sql(lines.BLOCKS)}, chr(10), 'g')"
    text = f"regexp_replace({text}, {_sql(lines.TAGS)}, '', 'g')"
    for entity, plain in lines.ENTITIES:
        text = f"replace({text}, {_sql(entity)}, {_sql(plain)})"
    return f"regexp_replace(coalesce({text}, ''), {_sql(lines.SPACE)}, ' ', 'g')"


ORACLES["op3_site_lines"] = f"""
with p as (
  select row_number() over () k, page_id, lower(coalesce(regexp_extract(url, {_sql(lines.HOST)}, 1), '')) host,
    list_filter(list_transform(string_split({_page_text_sql()}, chr(10)), lambda x: trim(x)), lambda x: x <> '') l
  from pages),
totals as (select host, count(*) n from p group by host),
common as (
  select host, line from (select k, host, unnest(list_distinct(l)) line from p) join totals using (host)
  group by host, line, n having count(*) >= {lines.LEAST_PAGES} and count(*) / n > {lines.RATIO}),
rows as (
  select p.k, line, nr, c.line is not null gone
  from (select k, host, unnest(l) line, unnest(range(len(l))) nr from p) p left join common c using (host, line)),
kept as (
  select k, count(*) filter (gone) n_dropped, string_agg(line, chr(10) order by nr) filter (not gone) t from rows group by k)
select page_id, host, len(l)::bigint n_lines, coalesce(n_dropped, 0)::bigint n_dropped, coalesce(t, '') kept_text
from p left join kept using (k)
"""


@_query
def op5_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = mix.sizes(table(spark, sf_dir, "documents"))
    chosen = mix.apply(rows.drop("u"), mix.plan(rows))
    return chosen.select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"))


_WEIGHT_SQL = f"(case (row_number() over (order by source nulls last) - 1) % 3 {' '.join(f'when {i} then {w}.0' for i, w in enumerate(mix.WEIGHTS))} end)::double"

ORACLES["op5_source_mix"] = f"""
with recursive d as (
  select doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+'))::bigint size,
    (('0x' || substr(md5('mix:' || coalesce(doc_id::varchar, 'null')), 1, 13))::bigint::double + 0.5) / 4503599627370496.0 u
  from documents),
s as (select source, sum(size)::bigint source_size from d group by source),
w as (select *, {_WEIGHT_SQL} w, source_size * 3.0::double cap, sum(source_size) over ()::double total,
        row_number() over (order by source nulls last) n from s),
l as (select *, (total - coalesce(sum(cap) over (o rows between unbounded preceding and 1 preceding), 0)) /
        sum(w) over (o rows between current row and unbounded following) level
      from w window o as (order by cap / w, n)),
f as (select *, cap / w <= level capped from l),
t as (select source, source_size, case when capped then cap else w * free end target
      from (select *, (total - coalesce(sum(cap) filter (capped) over (), 0)) / sum(w) filter (not capped) over () free from f)),
r as (select *, floor(ratio)::bigint whole, ratio - floor(ratio) p, target - floor(ratio) * source_size room
      from (select *, case when source_size > 0 then target / source_size else 0 end ratio from t)),
j as (select d.*, r.source_size, target, whole, p, room, case when p > 0 then (u / (1 - u)) / (p / (1 - p)) end q
      from d join r on d.source is not distinct from r.source),
c as (select doc_id, size, source, source_size, target, whole, p, room, q, upto <= room extra,
        min(row(q, doc_id)) filter (upto > room) over (partition by source) stop
      from (select *, sum(size) over (partition by source order by q, doc_id range between unbounded preceding and current row) upto from j where p > 0)),
rounds as (
  select 0 n, * from c
  union all
  select n + 1, doc_id, size, source, source_size, target, whole, p, room, q, extra or (fits and upto <= gap),
    min(row(q, doc_id)) filter (fits and upto > gap) over (partition by source)
  from (
    select *, sum(case when fits then size else 0 end) over (partition by source order by q, doc_id range between unbounded preceding and current row) upto,
      bool_or(fits) over (partition by source) goes_on
    from (
      select *, not extra and row(q, doc_id) > stop and size > 0 and size <= gap / 2 fits
      from (select *, room - sum(case when extra then size else 0 end) over (partition by source) gap from rounds where stop is not null)
      where gap > {mix._OPEN} * room))
  where goes_on),
g as (
  select *, room - sum(case when extra then size else 0 end) over (partition by source) gap
  from (select *, n = max(n) over (partition by source) final from rounds) where final),
z as (select source, arg_min(doc_id, (abs(gap - size), q, doc_id)) last from g where not extra and abs(gap - size) < gap group by source)
select j.doc_id, j.size, j.source_size, j.target,
  (j.size * (j.whole + coalesce(g.extra, false)::bigint + coalesce((z.last = j.doc_id and not coalesce(g.extra, false))::bigint, 0)))::bigint taken
from j left join g on j.source is not distinct from g.source and j.doc_id = g.doc_id
  left join z on j.source is not distinct from z.source
"""


@_query
def op6_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = neardup.near_duplicates(table(spark, sf_dir, "documents"))
    plain = [F.when(F.col(c) != LAST_ID, F.col(c)).alias(name) for c, name in (("id", "doc_id"), ("class", "class_id"))]
    return found.select(*plain, "keep")


@_query
def op7_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    said = "</s>[INST] ok [/INST]"
    # The contract's own conversation: two rows besides the table's.
    extra = spark.range(2).select(
        F.lit(-1).cast("long").alias("conv_id"), F.col("id").alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(said).alias("text"),
    )
    return chat.digests(chat.formatted(rows.unionByName(extra), tokenizer_file("byte_bpe_50k.json")))


@_query
def op8_kd_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = shards.assign(table(spark, sf_dir, "documents"), keep_text=False)
    return placed.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


@_query
def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = quality.fit(docs, table(spark, sf_dir, "labels"))
    held_out = F.coalesce(crc_of_id() % 3 == 1, F.lit(False)).alias("held_out")
    return quality.scored(docs.select("doc_id", "text", held_out), model).select("doc_id", "held_out", "score", "predicted")


@_query
def op4_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = suffixes.dedup(table(spark, sf_dir, "documents"))
    return cut.select(
        F.when(F.col("doc") != LAST_ID, F.col("doc")).alias("doc_id"), "n_bytes", "n_removed",
        F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"),
    )


@_query
def op9_katz_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return katz.scores(table(spark, sf_dir, "documents"))


@_query
def op12_harmonic_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = packing.pack(table(spark, sf_dir, "documents"), tokenizer_file("word_bpe_49k.json"))
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


@_query
def op11_structure_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = repair.with_faults(repair.damaged(table(spark, sf_dir, "conversations")))
    return repair.digests(repair.repaired(rows))


def _edited(x: str, cost: str, edit: str, line: str | None = None) -> str:
    """A state of the recursion, eight digits of cost, audit, chr(1), repaired lines, after one more edit."""
    audit, lines = f"substr({x}, 9, instr({x}, chr(1)) - 9)", f"substr({x}, instr({x}, chr(1)) + 1)"
    added = f" || chr(10) || {line}" if line else ""
    return f"(lpad((substr({x}, 1, 8)::bigint + {cost})::varchar, 8, '0') || {audit} || '{edit}' || chr(1) || {lines}{added})"


def _inserted(s: str, u: str, a: str) -> tuple[str, str]:
    user, assistant = "'user:'", "'assistant:'"
    return (
        f"least({u}, {', '.join(_edited(x, '2', 'I', user) for x in (s, 's1', a) if x)})",
        f"least({a}, {_edited(u, '2', 'I', assistant)})",
    )


_MOVED = "case when must then null else least({}) end"


def _moved(fits: str, initial: str, role: str, sources: tuple[str, ...]) -> str:
    """The best way into a state: its row deleted, kept or given the role."""
    ways = [f"case when i = '{initial}' then {_edited(x, 'extra', 'K', 'line')} end" for x in sources]
    ways += [_edited(x, "2 + extra", "R", f"'{role}:' || text") for x in sources]
    return f"least({_edited(fits, '3', 'D')}, {_MOVED.format(', '.join(ways))})"


_U1, _A1 = _inserted("s0", "s2", "s3")
_U2, _A2 = _inserted("s0", "s2", "s3")

ORACLES["op11_structure_repair"] = rf"""
with recursive crc_table as (
  select list(list_reduce(list_prepend(n, range(8)), lambda c, k: case when c & 1 = 1 then xor(c >> 1, 3988292384) else c >> 1 end) order by n) t
  from range(256) r(n)),
keyed as (
  select conv_id, turn, coalesce(role, ' ') r0, coalesce(text, ' ') t0,
    xor(list_reduce(list_prepend(4294967295::bigint, list_transform(string_split(coalesce(conv_id::varchar, ' ') || ':' || coalesce(turn::varchar, ' '), ''), lambda x: ord(x)::bigint)),
      lambda c, b: xor(c >> 8, t[1 + (xor(c, b) & 255)])), 4294967295) % 20 code
  from conversations, crc_table),
damaged as (
  select conv_id, turn, case when code = 4 then 'user' else r0 end as role,
    case when code = 1 then '' when code = 2 then translate(t0, '.!?', '') else t0 end as text
  from keyed, range(2) copies(n) where code <> 0 and (n = 0 or code = 3)),
placed as (
  select *, row_number() over (partition by conv_id, role, text order by pos) > 1 again,
    not regexp_matches(text, '[^\x20\x09-\x0D]') blank,
    right(rtrim(text, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 1) in ('.', '!', '?') ended
  from (select *, row_number() over (partition by conv_id order by turn nulls first, role, text) pos from damaged)),
rows as (
  select conv_id, pos, turn, role, text, role || ':' || text line, left(role, 1) i, blank, not blank and again dup, not blank and not again and not ended cut,
    blank or again must, (not blank and not again and not ended)::int extra,
    pos > 1 and lag(left(role, 1)) over (partition by conv_id order by pos) || left(role, 1) not in ('su', 'ua', 'au') illegal
  from placed),
walk as (
  select c.conv_id, 0::bigint pos, '00000000' || chr(1) s0, null::varchar s1, null::varchar s2, null::varchar s3
  from (select distinct conv_id from conversations) c
  union all
  select m.conv_id, m.pos, m.s0, m.s1, m.s2, m.s3 from (
    select r.conv_id, r.pos,
      {_edited("w.s0", "3", "D")} s0,
      least({_edited("w.s1", "3", "D")}, case when not must and i = 's' then {_edited("w.s0", "extra", "K", "line")} end) s1,
      {_moved("w.s2", "u", "user", ("w.s0", "w.s1", "w.s3"))} s2,
      {_moved("w.s3", "a", "assistant", ("w.s2",))} s3
    from (
      select conv_id, pos, s0, s1, {_U2} s2, {_A2} s3
      from (select conv_id, pos, s0, s1, {_U1} s2, {_A1} s3 from walk)) w
    join rows r on r.conv_id is not distinct from w.conv_id and r.pos = w.pos + 1) m),
ends as (
  select conv_id, least(s0, s3) best from (
    select conv_id, pos, s0, s1, {_U2} s2, {_A2} s3
    from (select conv_id, pos, s0, s1, {_U1} s2, {_A1} s3 from (
      select *, pos = max(pos) over (partition by conv_id) final from walk) where final))),
counts as (
  select conv_id, coalesce(max(turn) - min(turn) + 1 - count(distinct turn), 0) gaps, count(*) filter (blank) blank, count(*) filter (dup) dup,
    count(*) filter (cut) cut, count(*) filter (illegal) illegal
  from rows group by conv_id)
select e.conv_id, coalesce(gaps, 0)::bigint gaps, coalesce(blank, 0)::bigint blank, coalesce(dup, 0)::bigint "duplicate", coalesce(cut, 0)::bigint truncated,
  coalesce(illegal, 0)::bigint illegal, substr(best, 1, 8)::bigint "cost", substr(best, 9, instr(best, chr(1)) - 9) audit,
  sha256(substr(best, instr(best, chr(1)) + 2)) repaired_sha256
from ends e left join counts c on c.conv_id is not distinct from e.conv_id
"""


@_query
def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label").cast("long") + 1) % 10).otherwise(F.col("label")).cast("int")
    rows = negatives.valid_rows(vectors.withColumn("label", label), topk.quantised("embedding", 256))
    return negatives.mine(rows, F.col("vec_id") % 100 == 0)


ORACLES["op13_hard_negatives"] = """
with v as (
  select vec_id, (case when vec_id % 7 = 0 then (label + 1) % 10 else label end)::integer as label, list_transform(embedding, lambda x: floor(256 * x::double)) q
  from embeddings
  where vec_id is not null and label is not null and embedding is not null and len(embedding) > 0
    and len(list_filter(embedding, lambda x: x is null or not isfinite(x::double))) = 0),
s as (
  select a.vec_id anchor_id, b.vec_id, a.label = b.label same, list_inner_product(a.q, b.q)::bigint score
  from v a join v b on a.vec_id % 100 = 0 and a.vec_id <> b.vec_id),
p as (select * from s where same qualify row_number() over (partition by anchor_id order by score desc, vec_id) <= 5),
n as (
  select p.anchor_id, p.vec_id positive_id, s.vec_id negative_id, p.score positive_score, s.score negative_score,
    row_number() over (partition by p.anchor_id, p.vec_id order by s.score desc, s.vec_id) rank
  from p join s on p.anchor_id = s.anchor_id and not s.same and 80 * p.score <= 100 * s.score and s.score <= p.score)
select anchor_id, positive_id, rank::integer rank, negative_id, positive_score, negative_score from n where rank <= 5
"""

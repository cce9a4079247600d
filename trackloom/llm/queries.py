"""Queries of this subpackage and, where SQL can express them, their DuckDB text."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chat_format, decontamination, harmonic_packing, language_id, line_templates, lsm_dedup, pii, quality_gbt, simhash_bk, token_packing
from .common import held_out, read_table


def op1_bfd_token_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_packing.pack_token_ids(read_table(spark, sf_dir, "documents"))


def op2_line_templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    found = line_templates.drop_repeated_lines(docs, counts=("n_lines", "n_dropped"))
    return found.select("doc_id", "text", F.col("n_lines").cast("long").alias("n_lines"), F.col("n_dropped").cast("long").alias("n_dropped"))


_OP2_LINES = r"""
with split as (select doc_id, text, string_split(text, chr(10)) as parts from documents),
lines as (select doc_id, unnest(range(len(parts))) as pos, unnest(parts) as raw from split),
spaced as (select doc_id, pos, raw, trim(regexp_replace(raw, '\s+', ' ', 'g')) as exact from lines),
masked as (select *, regexp_replace(exact, '\S*[0-9]\S*', '<*>', 'g') as masked from spaced),
kept as (select doc_id, pos, len(string_split(masked, ' ')) >= 5 as long,
    string_split(case when long or regexp_matches(masked, '\p{L}') then masked
      when regexp_matches(exact, '\p{L}') and length(exact) >= 20 then regexp_replace(exact, '[0-9]+', '<*>', 'g') else exact end, ' ') as line
  from masked where masked != ''),
different as (select long, line, min(doc_id) as first, max(doc_id) as last from kept group by all),
part0 as (select line, [cast(len(line) as varchar)] || line[1:3] as part from different where long),
"""
#: One level of the tree: lines that take their part's template, and the parts of those that do not.
_OP2_LEVEL = """
tokens{k} as (select line, part, held, unnest(range(len(line))) as place, unnest(line) as token from (select *, count(*) over (partition by part) as held from part{k})),
places{k} as (select part, place, count(*) as kinds, max(held) as held, max(token) filter (2 * seen > held) as constant
  from (select part, place, token, held, count(*) as seen from tokens{k} group by all) group by part, place),
cut{k} as (select part, min({{'kinds': kinds, 'place': place}}) as cut from places{k} where kinds > 1 group by part),
judged{k} as (select t.line, t.part, any_value(p.held) as held, count(*) filter (t.token = p.constant) as agrees, max(t.token) filter (t.place = c.cut.place) as at_cut
  from tokens{k} t join places{k} p on t.part = p.part and t.place = p.place left join cut{k} c on c.part = t.part group by t.line, t.part),
taken{k} as (select line, part from judged{k} where held > 1 and agrees >= len(line) * cast(0.8 as double)),
part{next} as (select line, list_append(part, at_cut) as part from judged{k} where held > 1 and not agrees >= len(line) * cast(0.8 as double)),
"""
_OP2_DROPS = """
taken as (select * from taken0 union all select * from taken1 union all select * from taken2),
named as (select d.*, coalesce(t.part, d.line) as template, t.part is not null as general from different d left join taken t on d.long and d.line = t.line),
judged as (select long, line, min(first) over same as keeper, max(last) over same as other from named window same as (partition by long, template, general)),
dropped as (select k.doc_id, k.pos from kept k join judged j using (long, line) where j.keeper != j.other and k.doc_id != j.keeper),
rebuilt as (select l.doc_id, coalesce(string_agg(raw, chr(10) order by l.pos) filter (d.pos is null), '') as text, count(*) as n_lines, count(d.pos) as n_dropped
  from lines l left join dropped d on l.doc_id = d.doc_id and l.pos = d.pos group by l.doc_id)
select s.doc_id, case when r.n_dropped > 0 then r.text else s.text end as text, coalesce(r.n_lines, 0) as n_lines, coalesce(r.n_dropped, 0) as n_dropped
from split s left join rebuilt r using (doc_id)
"""
OP2 = _OP2_LINES + "".join(_OP2_LEVEL.format(k=k, next=k + 1) for k in range(3)) + _OP2_DROPS


def op3_quality_gbt(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    model = quality_gbt.train(docs, read_table(spark, sf_dir, "labels"))
    scored = quality_gbt.score(docs, model)
    return scored.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))


def op4_harmonic_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = harmonic_packing.harmonic_pack(read_table(spark, sf_dir, "documents"))
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def op5_lsm_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = lsm_dedup.exact_duplicates(read_table(spark, sf_dir, "documents"), keep="largest")
    return found.select("doc_id", "keep_id", "group_size", "kept", F.lower(F.hex("digest")).alias("text_sha256"))


OP5 = """
with d as (select doc_id, coalesce(text, '') as text from documents)
select doc_id, max(doc_id) over (partition by text) as keep_id, count(*) over (partition by text) as group_size,
  row_number() over (partition by text order by doc_id desc nulls last) = 1 as kept, sha256(text) as text_sha256
from d
"""


def op6_simhash_bk(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash_bk.near_duplicates(read_table(spark, sf_dir, "documents"))
    return found.select("doc_id", simhash_bk.fingerprint_hex(F.col("fp")).alias("fingerprint"), "component_id")


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    model = language_id.train(docs)
    found = language_id.predict(docs.select("doc_id", "text"), model)
    return found.select("doc_id", held_out().alias("held_out"), "lang_pred", "score")


def op8_pigeonhole_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.find_contamination(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))


def op9_pii_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.find_pii(read_table(spark, sf_dir, "documents"))
    counts = [F.size(k).cast("long").alias(f"n_{k}") for k in pii.BASE_KINDS]
    return found.select("doc_id", *counts, F.sha2(pii.span_list(pii.BASE_KINDS), 256).alias("base_sha256"), pii.span_list(pii.PATTERNS).alias("spans"))


def op10_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = "</s>[INST] ok [/INST]"
    role = F.when(F.col("id") == 0, "user").otherwise("assistant")
    extra = spark.range(2).select(F.lit(-1).cast("long").alias("conv_id"), F.col("id").alias("turn"), role.alias("role"), F.lit(words).alias("text"))
    table = read_table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(extra)
    turns = chat_format.format_turns(table)
    whole = chat_format.conversations(turns, chat_format.expand_examples(turns))
    read = whole.select("conv_id", "segments", F.transform("segments", chat_format.read_turn).alias("turns"), chat_format.read_losses(F.col("segments"), F.col("examples")).alias("losses"))
    said = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    chars = lambda texts: F.aggregate(texts, F.lit(0).cast("long"), lambda a, x: a + F.length(x))
    return read.select(
        "conv_id",
        F.size("segments").cast("long").alias("n_turns"),
        F.sha2(said, 256).alias("turns_sha256"),
        chars("losses").alias("loss_chars"),
        F.sha2(F.array_join("losses", ""), 256).alias("loss_sha256"),
        chars("segments").alias("formatted_chars"),
    )


_ESC = r"regexp_replace(replace({}, '\', '\\'), '(<)(/?s>|<SYS>>|</SYS>>)|(\[)(/?INST\])', '\1\3\\\2\4', 'g')"
OP10 = f"""
with c as (select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations
  union all select -1, 0, 'user', '</s>[INST] ok [/INST]' union all select -1, 1, 'assistant', '</s>[INST] ok [/INST]')
select conv_id, count(*) as n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' order by turn nulls first, role, text)) as turns_sha256,
  cast(coalesce(sum(length(text)) filter (role = 'assistant'), 0) as bigint) as loss_chars,
  sha256(coalesce(string_agg(text, '' order by turn nulls first, role, text) filter (role = 'assistant'), '')) as loss_sha256,
  cast(sum(length({_ESC.format("role")}) + length({_ESC.format("text")}) + length('<s>[INST][/INST]</s>')) as bigint) as formatted_chars
from c group by conv_id
"""


ALL = (
    op1_bfd_token_packing,
    op2_line_templates,
    op3_quality_gbt,
    op4_harmonic_packing,
    op5_lsm_exact_dedup,
    op6_simhash_bk,
    op7_language_id,
    op8_pigeonhole_decontamination,
    op9_pii_spans,
    op10_chat_format,
)


def queries() -> dict:
    return {f.__name__: f for f in ALL}


def oracle_sql() -> dict[str, str]:
    return {"op2_line_templates": OP2, "op5_lsm_exact_dedup": OP5, "op10_chat_format": OP10}

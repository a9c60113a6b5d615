"""The queries of this subpackage, by name, and their SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from vexel.llm import toxic
from vexel.llm.chat import rotate
from vexel.llm.common import Registry
from vexel.llm.crf import score_quality, train
from vexel.llm.exact import exact_copies
from vexel.llm.html import extract
from vexel.llm.media import embedding_images, media_tiles
from vexel.llm.mix import mix_schedule
from vexel.llm.ngramjoin import ngram_classes
from vexel.llm.pack import pack
from vexel.llm.repeats import repeated_passages


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op9_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_copies(_table(spark, sf_dir, "documents"))


#: The schedule of op1 with its default parameters: 16384 tokens a block, repeats (largest / own) ** 0.3 up to 4, seed 0.
_MIX = r"""
    with recursive d as (
        select doc_id, coalesce(source, chr(1)) s, coalesce(len(regexp_extract_all(text, '[^ \t\n\r\f\v]+')), 0)::bigint n,
               md5('0:' || coalesce(doc_id::varchar, '')) k from documents),
    p as (select doc_id, s, n, coalesce(sum(n) over (partition by s order by k, doc_id nulls first, n rows between unbounded preceding and 1 preceding), 0)::bigint pos from d),
    b as (select s, greatest(1, ceil(sum(n) / 16384.0))::bigint blocks from d group by s),
    w as (select s, blocks, blocks * least(4.0::double, pow(max(blocks) over () / blocks::double, 1.0::double - 0.7::double)) w from b),
    x as (select s, blocks, greatest(1, floor(round(w / sum(w) over (), 9) * 4294967296))::bigint points from w),
    y as (select s, blocks, points, sum(points) over ()::bigint total, row_number() over (order by points desc, s) rn from x),
    z as (select s, blocks, case when rn = 1 then points + 4294967296 - total else points end points from y),
    r as (select s, blocks, points, sum(points) over (order by s rows unbounded preceding)::bigint hi from z),
    slots as (select unnest(range(0, (select max(ceil((blocks + 8) * 4294967296.0 / points))::bigint from r))) slot),
    drawn as (select slot, s, blocks, row_number() over (partition by s order by slot) - 1 rank
              from slots join r on (slot + 1) * 2654435769 % 4294967296 >= hi - points and (slot + 1) * 2654435769 % 4294967296 < hi),
    sched as (select slot, s, rank // blocks epoch, rank % blocks block from drawn where slot <= (select max(slot) from drawn where rank = blocks - 1)),
    o as (select doc_id, s, n, pos, blocks, least(pos // 16384, blocks - 1) b0, case when n = 0 then least(pos // 16384, blocks - 1) else (pos + n - 1) // 16384 end b1 from p join b using (s)),
    pieces as (select doc_id, s, n, pos, unnest(range(b0, b1 + 1)) block from o)
    select slot, nullif(sched.s, chr(1)) source, epoch, sched.block, doc_id, least(n, greatest(0, pieces.block * 16384 - pos)) "start",
           greatest(0, least(n, (pieces.block + 1) * 16384 - pos) - greatest(0, pieces.block * 16384 - pos)) length
    from sched join pieces on sched.s = pieces.s and sched.block = pieces.block
"""


def op1_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_schedule(_table(spark, sf_dir, "documents"))


def op2_media_tiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The embeddings as images, since no table has any."""
    return media_tiles(embedding_images(_table(spark, sf_dir, "embeddings")))


def op3_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(_table(spark, sf_dir, "documents"))


def op4_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents that are kept, with their quality."""
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    model = train(docs, _table(spark, sf_dir, "labels"))
    return score_quality(docs, model, cut=model.cut).select("doc_id", "quality")


def op5_chat_rotation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rotate(_table(spark, sf_dir, "conversations"))


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The toxic documents."""
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    return toxic.toxic_documents(docs, toxic.train(docs, _table(spark, sf_dir, "labels")))


#: The words of a text: runs of letters and digits, only ASCII letters lower-cased.
_WORDS = "regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '(?:[0-9a-z]|[^\\x00-\\x7F])+')"

#: All windows of 50 words by their text.
_REPEATS = f"""
    with d as (select row_number() over (order by doc_id, text) k, doc_id, {_WORDS} w from (select distinct doc_id, text from documents where text is not null and doc_id is not null)),
    v as (select k, doc_id, unnest(range(0, len(w) - 49)) i, w from d),
    t as (select k, doc_id, i, array_to_string(w[i + 1:i + 50], ' ') body from v),
    f as (select body, min(doc_id) least from t group by body having min(doc_id) < max(doc_id)),
    h as (select k, doc_id, i, least, case when i - lag(i) over (partition by k order by i) <= 50 then 0 else 1 end new from t join f using (body)),
    o as (select *, sum(new) over (partition by k order by i) part from h)
    select doc_id, min(i) start_word, max(i) + 50 - min(i) n_words, min(least) first_doc_id from o group by k, doc_id, part
"""


def op7_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeated_passages(_table(spark, sf_dir, "documents"))



#: All pairs through an index of the word 3-grams, so only for small tables.
_CLASSES = f"""
    with recursive d as (select row_number() over (order by doc_id, text) k, doc_id, {_WORDS} w from (select distinct doc_id, text from documents where text is not null and doc_id is not null)),
    g as (select distinct k, unnest(case when len(w) < 3 then [array_to_string(w, ' ')] else list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]) end) gram from d where len(w) > 0),
    s as (select k, count(*) n from g group by k),
    c as (select x.k a, y.k b, count(*) shared from g x join g y on x.gram = y.gram and x.k < y.k group by all),
    p as (select a, b from c join s x on x.k = a join s y on y.k = b where shared >= 0.5 * (x.n + y.n - shared)),
    e as (select a, b from p union all select b, a from p),
    r as (select a k, a other from e union select r.k, e.b from r join e on r.other = e.a)
    select d.doc_id, min(m.doc_id) class_id, any_value(links) links
    from d join (select a, count(*) links from e group by a) on d.k = a join r using (k) join d m on m.k = r.other group by d.k, d.doc_id
"""


def op8_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document with a near copy: its class and the number of its links."""
    return ngram_classes(_table(spark, sf_dir, "documents"))


def op10_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(_table(spark, sf_dir, "pages"))


def queries() -> Registry:
    return {f.__name__: f for f in (op1_mix_sources, op2_media_tiles, op3_best_fit_packing, op4_quality_classifier, op5_chat_rotation, op6_toxicity, op7_suffix_array_dedup, op8_ngram_jaccard_join, op9_exact_dedup, op10_html_extraction)}


def oracle_sql() -> dict[str, str]:
    return {
        "op1_mix_sources": _MIX,
        "op5_chat_rotation": r"""
            with m as (select conv_id, turn, coalesce(role, 'unknown') r, coalesce(text, '') x from conversations),
            g as (select conv_id, list({'t': turn, 'r': r, 'x': x} order by turn nulls first, r, x) ms from m group by conv_id),
            s as (select distinct g.conv_id, m.r speaker, ms from g join m on g.conv_id is not distinct from m.conv_id where m.r <> 'system'),
            p as (select conv_id, speaker, list_transform(ms, lambda m: {
                'h': '<|im_start|>' || case when m.r = speaker then 'assistant' when m.r = 'system' then 'system' else 'user name=' || replace(m.r, '<|', '<\|') end || chr(10),
                'b': replace(m.x, '<|', '<\|') || '<|im_end|>' || chr(10), 'k': case when m.r = speaker then 1 else 0 end}) q from s)
            select conv_id, speaker, list_reduce(list_transform(q, lambda v: v.h || v.b), lambda a, b: a || b) "text",
                   flatten(list_transform(q, lambda v: [length(v.h)::int, length(v.b)::int])) lengths, flatten(list_transform(q, lambda v: [0::int, v.k::int])) trained
            from p
        """,
        "op7_suffix_array_dedup": _REPEATS,
        "op8_ngram_jaccard_join": _CLASSES,
        "op9_exact_dedup": """
            with g as (select text, min(doc_id) keep_id from documents where text is not null and doc_id is not null group by text)
            select distinct g.keep_id, d.doc_id copy_id from documents d join g using (text) where d.doc_id <> g.keep_id
        """,
    }

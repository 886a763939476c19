"""Pixel relations derived from the test tables, in Spark and in DuckDB's SQL: FIXTURES.md describes them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

QS = "cast(greatest(0, least(255, floor((cast({0} as double) + 0.6D) * 212))) as int)"
QD = "cast(greatest(0, least(255, floor((cast({0} as double) + 0.6::double) * 212))) as int)"

SPARK = {
    "gray": f"select vec_id image_id, i % 8 x, i div 8 y, {QS.format('v')} g from (select vec_id, posexplode(embedding) as (i, v) from embeddings)",
    "rgba": f"""select vec_id image_id, (i-1)%8 x, cast((i-1) div 8 as int) y, 255-(i-1)*3 a, {QS.format('embedding[i-1]')} r, {QS.format('embedding[64-i]')} g, {QS.format('embedding[(i*7)%64]')} b
        from (select vec_id, embedding, explode(sequence(1, 64)) i from embeddings)""",
    "events": "select 0 image_id, cast(event_id % 100 as int) x, cast(event_id div 100 as int) y, 255 a, cast(least(255, greatest(0, floor(value*255/500))) as int) r, cast(user_id % 256 as int) g, length(event_type)*16 b from events",
    "heat": "select 0 image_id, l_linenumber-1 x, l_orderkey y, 255 a, cast(least(255, sum(l_quantity)) as int) r, 0 g, cast(count(*) as int) b from lineitem group by l_linenumber, l_orderkey",
    "doc": """select doc_id image_id, p % 32 x, cast(p div 32 as int) y, 255 a, ascii(c) % 256 r, 0 g, 0 b
        from (select doc_id, posexplode(slice(split(text, ''), 1, char_length(text))) as (p, c) from documents where char_length(text) > 0)""",
    "palette": "select n_nationkey idx, 255 a, (n_nationkey*37)%256 r, (n_nationkey*91+17)%256 g, (n_nationkey*151+5)%256 b from nation",
}
#: With the width and height of each image, as a file's header gives them: known before there are pixels.
SIZED = {
    "doc": """select doc_id image_id, p % 32 x, cast(p div 32 as int) y, 255 a, ascii(c) % 256 r, 0 g, 0 b, least(32, n) width, cast((n + 31) div 32 as int) height
        from (select doc_id, n, posexplode(slice(split(text, ''), 1, char_length(text))) as (p, c)
            from (select doc_id, text, max(char_length(text)) over (partition by doc_id) n from documents where char_length(text) > 0 and doc_id is not null))""",
}
TABLES = {"gray": "embeddings", "rgba": "embeddings", "events": "events", "heat": "lineitem", "doc": "documents", "palette": "nation"}

DUCK = {
    "gray": f"select vec_id image_id, (i-1)%8 x, (i-1)//8 y, {QD.format('embedding[i]')} g from embeddings, range(1,65) t(i)",
    "rgba": f"select vec_id image_id, (i-1)%8 x, (i-1)//8 y, 255-(i-1)*3 a, {QD.format('embedding[i]')} r, {QD.format('embedding[65-i]')} g, {QD.format('embedding[(i*7)%64+1]')} b from embeddings, range(1,65) t(i)",
    "events": "select 0 image_id, event_id % 100 x, event_id // 100 y, 255 a, cast(least(255, greatest(0, floor(value*255/500))) as int) r, cast(user_id % 256 as int) g, length(event_type)*16 b from events",
    "heat": "select 0 image_id, l_linenumber-1 x, l_orderkey y, 255 a, cast(least(255, sum(l_quantity)) as int) r, 0 g, cast(count(*) as int) b from lineitem group by l_linenumber, l_orderkey",
    "doc": "select doc_id image_id, (p-1)%32 x, (p-1)//32 y, 255 a, unicode(c) % 256 r, 0 g, 0 b from (select doc_id, unnest(string_split(text, '')) c, unnest(range(1, length(text)+1)) p from documents where length(text) > 0)",
    "palette": "select n_nationkey idx, 255 a, (n_nationkey*37)%256 r, (n_nationkey*91+17)%256 g, (n_nationkey*151+5)%256 b from nation",
}


#: The relation of documents by its other name.
DUCK["whole_doc"] = DUCK["doc"]


def pixels(spark: SparkSession, sf_dir: str, name: str, sized: bool = False) -> DataFrame:
    """sized: with the columns width and height, if the fixture knows them. Images without an id, which are equal to none, then go."""
    table = TABLES[name]
    made = SIZED.get(name, SPARK[name]) if sized else SPARK[name]
    return spark.sql(made.replace(f"from {table}", "from {source}"), source=spark.read.parquet(f"{sf_dir}/{table}.parquet"))

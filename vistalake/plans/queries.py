"""A query for each operator, over the test tables, and the same in DuckDB's SQL."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vistalake.functions.hashes import dhash, hamming
from vistalake.functions.vectors import l2_normalize, norm
from vistalake.operators import clustering, duplicates, frames, listing, organize, progress, scoring, similarity, tag_index, tagging, text, text_index, vector_index
from vistalake.plans.views import catalog, table, view, with_views
from vistalake.sources import catalog as sources
from vistalake.sources import folders, tables

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None, *views: str):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = with_views(sql, *views) if views else sql
        return f

    return register


def joined(c: Column | str) -> Column:
    return F.coalesce(F.array_join(c, "|"), F.lit("-"))


def rounded(c: Column | str, digits: int = 6) -> Column:
    return F.round(c, digits)


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), "embedding", "label")


DOT = "list_sum(list_transform(list_zip({a}::double[], {b}::double[]), lambda z: z[1] * z[2]))"
UNIT = "list_transform({v}::double[], lambda x: x / sqrt(list_sum(list_transform({v}::double[], lambda y: y * y))))"


def vector_sum(c: str) -> Column:
    """A number that stands for a vector in comparisons: components weighted by place."""
    return rounded(F.aggregate(F.transform(c, lambda x, i: x * (i + 1)), F.lit(0.0), lambda acc, x: acc + x), 5)


VSUM = "round(list_sum(list_transform({v}, lambda x, i: x * i)), 5)"


# ---- sources -------------------------------------------------------------------------------------

@query("""select path, length from manifest where regexp_matches(lower(path), '\\.(jpg|jpeg|png|webp|bmp|mp4|avi|mov|mkv|webm)$')
  and not regexp_matches(path, '/\\.[^/]*/') and not starts_with(path, '/lib/sorted/')""", "manifest")
def s1_inventory(spark, sf_dir):
    return sources.inventory(view(spark, sf_dir, "manifest"), exclude=("/lib/sorted",)).select("path", "length")


def files_of_documents(spark: SparkSession, sf_dir: str) -> str:
    """A folder in which each document is a file, with names that Spark's own listing hides, in dot-folders and an excluded folder as well."""
    target = tables.fresh_path(spark, "files")

    def store(batches):
        import pyarrow as pa
        from pyarrow.fs import FileSystem

        fs, root = FileSystem.from_uri(target if ":/" in target else f"file://{target}")
        for batch in batches:
            for path, content in zip(batch.column("path").to_pylist(), batch.column("content").to_pylist()):
                fs.create_dir(f"{root}/{path}".rpartition("/")[0], recursive=True)
                with fs.open_output_stream(f"{root}/{path}") as f:
                    f.write(content)
            yield pa.RecordBatch.from_arrays([batch.column("path")], ["path"])

    folder = F.element_at(F.array(*[F.lit(x) for x in ("a", "a/_b", ".cache", "sorted", "sorted2/c/.git", "a/b.c/d")]), (F.col("doc_id") % 6 + 1).cast("int"))
    name = F.element_at(F.array(*[F.lit(x) for x in (".JPG", ".mp4", ".txt", ".webp")]), (F.col("doc_id") % 4 + 1).cast("int"))
    first = F.element_at(F.array(*[F.lit(x) for x in ("d", "_d", ".d")]), (F.col("doc_id") % 7 % 3 + 1).cast("int"))
    docs = table(spark, sf_dir, "documents").select(F.concat(folder, F.lit("/"), first, F.col("doc_id").cast("string"), name).alias("path"), F.coalesce("text", F.lit("")).cast("binary").alias("content"))
    docs.mapInArrow(store, "path string").write.format("noop").mode("overwrite").save()
    return target


@query("""with d as (select concat(['a', 'a/_b', '.cache', 'sorted', 'sorted2/c/.git', 'a/b.c/d'][doc_id % 6 + 1], '/', ['d', '_d', '.d'][doc_id % 7 % 3 + 1], doc_id::varchar, ['.JPG', '.mp4', '.txt', '.webp'][doc_id % 4 + 1]) as path,
   encode(coalesce(text, '')) as b, doc_id from documents)
  select path, octet_length(b)::bigint as length, md5(concat(lower(hex(b[1:8192])), '_', lower(hex(b[greatest(octet_length(b) - 8191, 1):])))) as ends, case when doc_id % 4 = 1 then 'video' else 'image' end as media_type
  from d where doc_id % 6 in (0, 1, 5) and doc_id % 4 <> 2""")
def s1_list_folders(spark, sf_dir):
    root = files_of_documents(spark, sf_dir)
    plain = folders.plain_path(root)
    found = sources.inventory(folders.list_folders(spark, root, exclude=(f"{plain}/sorted",)), root=plain)
    ends = F.md5(F.concat(F.lower(F.hex("head")), F.lit("_"), F.lower(F.hex("tail"))))
    return sources.with_media_type(found).select(F.expr(f"substring(path, {len(plain) + 2})").alias("path"), "length", ends.alias("ends"), "media_type")


@query("select path, case when regexp_matches(lower(path), '\\.(mp4|avi|mov|mkv|webm)$') then 'video' else 'image' end as media_type from manifest", "manifest")
def s2_media_type(spark, sf_dir):
    return sources.with_media_type(view(spark, sf_dir, "manifest")).select("path", "media_type")


@query("""with d as (select doc_id, n_chars, encode(text) as b from documents)
  select doc_id, md5(concat(n_chars::varchar, '_', (doc_id * 1000)::varchar, '_', lower(hex(b[1:8192])), '_', lower(hex(b[greatest(octet_length(b) - 8191, 1):])))) as file_hash from d""")
def s3_fingerprint(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", F.concat(F.lit("/d/"), F.col("doc_id").cast("string")).alias("path"), F.col("n_chars").alias("length"),
                                                    (F.col("doc_id") * 1000).alias("modified_us"), F.col("text").cast("binary").alias("content"))
    return sources.with_fingerprint(docs).select("doc_id", "file_hash")


@query("""select path as file_path, md5(path) as file_hash, length as file_size, case when regexp_matches(lower(path), '\\.(mp4|avi|mov|mkv|webm)$') then 'video' else 'image' end as media_type,
  cast(length as double) as created_at, cast(length as double) as modified_at, false as is_processed from manifest""", "manifest")
def s4_media_items(spark, sf_dir):
    rows = view(spark, sf_dir, "manifest").withColumn("modified_at", F.col("length").cast("double")).withColumn("file_hash", F.md5("path"))
    return sources.to_media_items(sources.with_media_type(rows))


def changed_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Even media rows with new size, hash and tags; every third of them twice, the second with another hash."""
    rows = view(spark, sf_dir, "media").filter("id % 2 = 0").withColumn("seq", F.explode(F.when(F.col("id") % 3 == 0, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1)))))
    return rows.select(
        "file_path", F.when(F.col("id") % 4 == 0, F.col("file_hash")).otherwise(F.md5(F.concat(F.lit("n"), F.col("id").cast("string"), F.col("seq").cast("string")))).alias("file_hash"),
        (F.col("file_size") + F.col("seq")).alias("file_size"), "media_type", "created_at", "width", "height", "duration", (F.col("id") % 10 != 0).alias("success"),
        F.when(F.col("id") % 10 == 0, "failed").alias("error_msg"), F.concat(F.lit("t"), F.col("seq").cast("string")).alias("tag"), F.col("seq").cast("bigint").alias("seq"))


BATCH = """batch as (select file_path, case when id % 4 = 0 then file_hash else md5(concat('n', id::varchar, seq::varchar)) end as file_hash, file_size + seq as file_size, media_type, created_at,
  width, height, duration, id % 10 <> 0 as success, case when id % 10 = 0 then 'failed' end as error_msg, concat('t', seq::varchar) as tag, seq::bigint as seq
  from media, (select unnest([1, 2]) as seq) where id % 2 = 0 and (seq = 1 or id % 3 = 0)), old as (select * from media where id % 3 <> 0)"""


@query(f"""select b.file_path, b.file_hash from (with {BATCH} select b.* from batch b where not exists
  (select 1 from old o where o.is_processed and o.file_path = b.file_path and o.file_hash = b.file_hash)) b""", "media")
def s5_pending(spark, sf_dir):
    old = view(spark, sf_dir, "media").filter("id % 3 <> 0")
    return sources.pending(changed_batch(spark, sf_dir), old).select("file_path", "file_hash")


@query(f"""select * from (with {BATCH}, f as (select * from batch where seq = 1), l as (select * from batch qualify row_number() over (partition by file_path order by seq desc) = 1)
  select coalesce(o.file_path, l.file_path) as file_path, o.id as old_id, case when l.file_path is not null then l.file_hash else o.file_hash end as file_hash,
   case when o.id is not null then o.file_size else f.file_size end as file_size, case when o.id is not null then o.duration else f.duration end as duration,
   case when l.file_path is not null then l.success else o.is_processed end as is_processed, case when l.file_path is not null then l.error_msg else o.error_msg end as error_msg
  from old o full join l on o.file_path = l.file_path left join f on f.file_path = l.file_path)""", "media")
def s6_upsert(spark, sf_dir):
    old = view(spark, sf_dir, "media").filter("id % 3 <> 0").drop("label", "modified_at")
    top = F.col("id") <= table(spark, sf_dir, "embeddings").agg(F.max("vec_id")).first()[0]
    new = sources.upsert_catalog(old, changed_batch(spark, sf_dir))
    return new.select("file_path", F.when(top & (F.col("id") % 3 != 0), F.col("id")).alias("old_id"), "file_hash", "file_size", "duration", "is_processed", "error_msg")


@query(f"""select * from (with {BATCH}, new as (select distinct file_path from batch where file_path not in (select file_path from old))
  select count(*) as n, count(*) as n_ids, (select max(id) from old) + 1 as low, (select max(id) from old) + count(*) as high from new)""", "media")
def s6_new_ids(spark, sf_dir):
    old = view(spark, sf_dir, "media").filter("id % 3 <> 0").drop("label", "modified_at")
    new = sources.upsert_catalog(old, changed_batch(spark, sf_dir)).join(old.select("file_path").hint("merge"), "file_path", "left_anti")
    return new.agg(F.count(F.lit(1)).alias("n"), F.countDistinct("id").alias("n_ids"), F.min("id").alias("low"), F.max("id").alias("high"))


@query("select id, file_path, cast(null as varchar) as tag_text, cast(null as double) as fps, is_processed from media", "media")
def s7_evolve_schema(spark, sf_dir):
    grown = sources.evolve_schema(view(spark, sf_dir, "media").select("id", "file_path", "is_processed"))
    return grown.select("id", "file_path", F.array_join("tags", ",").alias("tag_text"), "fps", "is_processed")


@query(f"""select id, {VSUM.format(v=UNIT.format(v='e'))} as weight from (select vec_id as id, case when vec_id % 2 = 0 then list_transform(embedding::double[], lambda x, i: x * i) else embedding::double[] end as e
  from embeddings)""")
def s8_append_vectors(spark, sf_dir):
    all_rows = vectors(spark, sf_dir).select("id", F.col("embedding").cast("array<double>").alias("embedding"))
    twice = all_rows.filter("id % 2 = 0").withColumn("seq", F.explode(F.array(F.lit(1), F.lit(2))))
    scaled = twice.withColumn("embedding", F.when(F.col("seq") == 2, F.transform("embedding", lambda x, i: x * (i + 1))).otherwise(F.transform("embedding", lambda x: -x))).withColumn("success", F.lit(True))
    out = sources.append_vectors(all_rows.withColumn("embedding", l2_normalize("embedding")), scaled)
    return out.select("id", vector_sum("embedding").alias("weight"))


@query(f"""select video_id as file_id, frame_no as face_index, case when frame_no < 3 then frame_no * 1.5 else 0.0 end::double as timestamp, {VSUM.format(v=UNIT.format(v='embedding'))} as weight
  from frames join embeddings using (vec_id)""", "frames")
def s9_explode_faces(spark, sf_dir):
    rows = view(spark, sf_dir, "frames").join(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"), "vec_id")
    ordered = F.array_sort(F.collect_list(F.struct("frame_no", "embedding")))
    results = rows.groupBy(F.col("video_id").alias("file_id")).agg(F.transform(ordered, lambda x: x["embedding"]).alias("face_vectors"),
                                                                   F.slice(F.transform(ordered, lambda x: F.struct((x["frame_no"] * 1.5).cast("double").alias("timestamp"))), 1, 3).alias("faces"))
    return sources.explode_faces(results).select("file_id", F.col("face_index").cast("bigint").alias("face_index"), "timestamp", vector_sum("embedding").alias("weight"))


@query("""select video_id as file_id, case when video_id % 3 = 0 then least(2, count(*)) else count(*) end as n, case when video_id % 3 = 0 then least(2, count(*)) else 0 end as n_new,
   case when video_id % 3 <> 0 then min(vec_id) end as least_old from frames group by video_id""", "frames")
def s9_replace_faces(spark, sf_dir):
    rows = view(spark, sf_dir, "frames").join(table(spark, sf_dir, "embeddings").select("vec_id", "embedding").hint("merge"), "vec_id")
    old = rows.select(F.col("vec_id").alias("id"), F.col("video_id").alias("file_id"), F.col("frame_no").cast("int").alias("face_index"), F.lit(0.0).alias("timestamp"), F.col("embedding").cast("array<double>").alias("embedding"), F.lit(5).alias("cluster_id"))
    found = rows.filter("video_id % 3 = 0").groupBy(F.col("video_id").alias("file_id")).agg(F.slice(F.transform(F.array_sort(F.collect_list(F.struct("frame_no", "embedding"))), lambda x: x["embedding"]), 1, 2).alias("face_vectors"))
    new = sources.explode_faces(found.withColumn("faces", F.array().cast("array<struct<timestamp:double>>")))
    out = sources.replace_faces(old, new)
    is_new = F.col("cluster_id") == -1
    return out.groupBy("file_id").agg(F.countDistinct("id").alias("n"), F.count_if(is_new & (F.col("id") > old.agg(F.max("id")).first()[0])).alias("n_new"), F.min(F.when(~is_new, F.col("id"))).alias("least_old"))


@query("select id, file_path, file_size, media_type from media", "media")
def s10_save_load(spark, sf_dir):
    path = tables.fresh_path(spark, "catalog")
    tables.save(view(spark, sf_dir, "media"), path)
    return tables.load(spark, path).select("id", "file_path", "file_size", "media_type")


@query("""select id, coalesce(array_to_string(tags, '|'), '') as tags, coalesce('["' || array_to_string(tags, '","') || '"]', '[]') as as_json from tags""", "tags")
def s11_tags_json(spark, sf_dir):
    rows = view(spark, sf_dir, "tags").withColumn("as_json", sources.tags_to_json(F.col("tags")))
    stored = F.when(F.col("tags").isNull(), F.when(F.col("id") % 3 == 0, "{not json").when(F.col("id") % 3 == 1, "")).otherwise(F.col("as_json"))
    return rows.select("id", F.array_join(sources.tags_from_json(stored), "|").alias("tags"), "as_json")


@query("select vec_id::int as idx, concat('tag_', vec_id::varchar) as name, (case vec_id % 4 when 0 then 0 when 1 then 1 when 2 then 3 else 4 end)::int as category from embeddings")
def s12_load_vocab(spark, sf_dir):
    path = tables.fresh_path(spark, "vocabulary")
    vocabulary(spark, sf_dir).write.csv(path, header=True)
    return sources.load_vocab(spark, path)


def vocabulary(spark: SparkSession, sf_dir: str) -> DataFrame:
    category = F.element_at(F.array(F.lit(0), F.lit(1), F.lit(3), F.lit(4)), (F.col("vec_id") % 4 + 1).cast("int"))
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").cast("int").alias("idx"), F.concat(F.lit("tag_"), F.col("vec_id").cast("string")).alias("name"), category.alias("category"))


@query("""select split_part(substring(path, 6), '/', 1) as category, path from manifest where regexp_matches(substring(path, 6), '^[^/]+/[^/]+$') and regexp_matches(lower(path), '\\.(jpg|jpeg|png|webp)$')""", "manifest")
def s13_load_labelled(spark, sf_dir):
    return sources.load_labelled(view(spark, sf_dir, "manifest").withColumn("root", F.lit("/lib")))


CENTROIDS = f"""(select category, {UNIT.format(v='m')} as embedding from (select category, list(x order by pos) as m from (select category, pos, avg(x) as x from
  (select {{by}} as category, unnest({{v}}) as x, generate_subscripts({{v}}, 1) as pos from embeddings {{where}}) group by category, pos) group by category))"""


@query(f"""select category, {VSUM.format(v='embedding')} as weight from (select * from {CENTROIDS.format(by='label', v='embedding::double[]', where='')} where category >= 5
  union all select * from {CENTROIDS.format(by='label', v='embedding::double[]', where='')} where category < 5)""")
def s14_update_centroids(spark, sf_dir):
    whole = tagging.train_centroids(vectors(spark, sf_dir), "label")
    old = tagging.train_centroids(vectors(spark, sf_dir).withColumn("embedding", F.transform("embedding", lambda x: -x)), "label").withColumn("embedding", F.when(F.col("label") >= 5, F.transform("embedding", lambda x: -x)).otherwise(F.col("embedding")))
    return sources.update_centroids(old.withColumnRenamed("label", "category"), whole.filter("label < 5").withColumnRenamed("label", "category")).select("category", vector_sum("embedding").alias("weight"))


# ---- listing ---------------------------------------------------------------------------------------

@query("""select id, file_path, media_type, created_at, width, height, coalesce(array_to_string(character_tags, '|'), '-') as characters, coalesce(array_to_string(series_tags, '|'), '-') as series
  from catalog where is_processed and coalesce(len(list_filter(character_tags, lambda x: lower(x) = 'alice w')) > 0, false) and media_type = 'image' order by created_at desc, id limit 50 offset 5""", "catalog")
def f1_list_media(spark, sf_dir):
    out = listing.list_media(catalog(spark, sf_dir), 50, 5, character="Alice W", series="All", media_type="Image")
    return out.select("id", "file_path", "media_type", "created_at", "width", "height", joined("character_tags").alias("characters"), joined("series_tags").alias("series"))


@query("select id, coalesce(len(list_filter(tags, lambda x: lower(x) = 'sky')) > 0, false) as has_sky, coalesce(len(list_filter(character_tags, lambda x: lower(x) = 'alice%')) > 0, false) as has_wild from tags", "tags")
def f2_has_tag(spark, sf_dir):
    index = tag_index.TagIndex.build(catalog(spark, sf_dir))
    out = index.has_tag(index.has_tag(view(spark, sf_dir, "tags").select("id"), "tag", "SKY", "has_sky"), "character", "alice%", "has_wild")
    return out.select("id", "has_sky", "has_wild")


@query("""select kind, id from (
  select 'tag' as kind, id from catalog where is_processed and error_msg is null and len(list_filter(tags, lambda x: contains(lower(x), 'sk'))) > 0 union all
  select 'year', id from catalog where is_processed and error_msg is null and created_at >= epoch(timestamp '2024-01-01') and created_at <= epoch(timestamp '2024-12-31 23:59:59') union all
  select 'media_type', id from catalog where is_processed and error_msg is null and media_type = 'video' union all
  select 'character', id from catalog where is_processed and error_msg is null and len(list_filter(character_tags, lambda x: contains(lower(x), 'alice'))) > 0 union all
  select 'series', id from catalog where is_processed and error_msg is null and len(list_filter(series_tags, lambda x: contains(lower(x), 'zero'))) > 0)""", "catalog")
def f3_match_condition(spark, sf_dir):
    rows, out = catalog(spark, sf_dir), None
    index = tag_index.TagIndex.build(rows)
    for kind, value in (("tag", "SK"), ("year", "2024"), ("media_type", "Movies"), ("character", "Alice"), ("series", "zero")):
        found = index.match_condition(rows, kind, value).select(F.lit(kind).alias("kind"), "id")
        out = found if out is None else out.unionByName(found)
    return out


@query("""select facet, value, count(*) as n from (select 'character' as facet, unnest(character_tags) as value from catalog where is_processed
  union all select 'series', unnest(series_tags) from catalog where is_processed) group by all""", "catalog")
def f4_facets(spark, sf_dir):
    return tag_index.TagIndex.build(catalog(spark, sf_dir)).facets()


TOP = f"select id, {DOT.format(a='embedding', b='(select ' + UNIT.format(v='embedding') + ' from embeddings where vec_id = 0)')} as score from (select vec_id as id, embedding from embeddings)"


def query_vector(spark: SparkSession, sf_dir: str) -> list[float]:
    return table(spark, sf_dir, "embeddings").filter("vec_id = 0").first()["embedding"]


@query(f"""select id, round(score, 6) as score from (select * from ({TOP}) order by score desc, id limit 100) join catalog using (id)
  where media_type = 'image' and list_contains(series_tags, 'wonder')""", "catalog")
def f5_filter_results(spark, sf_dir):
    best = similarity.top_k_similar(vectors(spark, sf_dir), query_vector(spark, sf_dir), 100)
    found = listing.filter_results(best.join(catalog(spark, sf_dir), "id"), "image", "All", "wonder")
    return found.select("id", rounded("score").alias("score"))


FILTERED = {"media_type": "image", "series": "wonder"}


@query(f"""select id, round(score, 6) as score, text_hit from (select id, score, false as text_hit from ({TOP}) join catalog using (id)
  where media_type = 'image' and list_contains(series_tags, 'wonder') order by score desc, id limit 50)""", "catalog")
def f5_pre_filter(spark, sf_dir):
    found = similarity.filtered_search(catalog(spark, sf_dir), vectors(spark, sf_dir), view(spark, sf_dir, "seg"), "thing", query_vector(spark, sf_dir), pre_filter=True, **FILTERED)
    return found.select("id", rounded("score").alias("score"), "text_hit")


@query("""select id, rank, (select count(*) > 150 from media where is_processed) as has_more from
  (select id, row_number() over (order by created_at desc, id) - 100 as rank from media where is_processed) where rank between 1 and 50""", "media")
def f6_page(spark, sf_dir):
    rows = view(spark, sf_dir, "media").filter("is_processed")
    return listing.Pages(rows, ranges=16).page(50, 100).select("id", F.col("rank").cast("bigint").alias("rank"), "has_more")


@query("select a.id, file_path, media_type, m.id is not null as found from (select distinct conv_id as id from conversations) a left join media m on a.id = m.id", "media")
def f7_lookup(spark, sf_dir):
    asked = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("id")).distinct()
    return sources.lookup(view(spark, sf_dir, "media"), asked).select("id", "file_path", "media_type", "found")


# ---- vectors -----------------------------------------------------------------------------------------

@query(f"select vec_id as id, {VSUM.format(v=UNIT.format(v='e'))} as weight, 1.0::double as size from (select vec_id, list_transform(embedding::double[], lambda x, i: x * i) as e from embeddings)")
def v1_l2_normalize(spark, sf_dir):
    scaled = vectors(spark, sf_dir).withColumn("embedding", F.transform(F.col("embedding").cast("array<double>"), lambda x, i: x * (i + 1)))
    unit = scaled.select("id", l2_normalize("embedding").alias("u"))
    return unit.select("id", vector_sum("u").alias("weight"), rounded(norm("u"), 9).alias("size"))


@query(f"select id, round(score, 6) as score, file_path from (select * from ({TOP}) order by score desc, id limit 20) join media using (id)", "media")
def v2_top_k(spark, sf_dir):
    return similarity.top_k_similar(vectors(spark, sf_dir), query_vector(spark, sf_dir), 20, view(spark, sf_dir, "media")).select("id", rounded("score").alias("score"), "file_path")


@query(f"""select id, round(score, 6) as score, file_path from (select id, {DOT.format(a='j.embedding', b='(select ' + UNIT.format(v='embedding') + ' from embeddings where vec_id = 9)')} as score
  from (select id, {UNIT.format(v='embedding')} as embedding from jit) j order by score desc, id limit 20) join (select id, file_path from media) using (id)""", "jit", "media")
def v2_indexed_top_k(spark, sf_dir):
    rows = view(spark, sf_dir, "jit").select("id", "embedding")
    index = vector_index.VectorIndex.build(rows.filter("id < 1000000").withColumn("embedding", F.transform("embedding", lambda x: -x)), cell_rows=256)
    index.append(rows.withColumn("success", F.lit(True)).withColumn("seq", F.lit(1)), cell_rows=256)  # the first vectors are replaced
    asked = table(spark, sf_dir, "embeddings").filter("vec_id = 9").first()["embedding"]
    return index.top_k(asked, 20, view(spark, sf_dir, "media")).select("id", rounded("score").alias("score"), "file_path")


@query(f"""select query_id, id, round(score, 6) as score, rank from (select q.vec_id as query_id, v.vec_id as id, {DOT.format(a='q.u', b='v.embedding')} as score,
  row_number() over (partition by q.vec_id order by {DOT.format(a='q.u', b='v.embedding')} desc, v.vec_id) as rank from (select vec_id, {UNIT.format(v='embedding')} as u from embeddings where vec_id % 20 = 0) q, embeddings v) where rank <= 10""")
def v2_top_k_batch(spark, sf_dir):
    rows = vectors(spark, sf_dir)
    asked = rows.filter("id % 20 = 0").select(F.col("id").alias("query_id"), "embedding")
    return similarity.top_k_batch(rows, asked, 10).select("query_id", "id", rounded("score").alias("score"), F.col("rank").cast("bigint").alias("rank"))


@query(f"""select id, file_path, media_type, round(coalesce(score, 1.0), 6) as score, text_hit, snippet from (
  select coalesce(t.id, v.id) as id, t.id is not null as text_hit, v.score from
   (select id from media where media_type = 'video' and id in (select id from seg where contains(lower(text), 'thing')) order by id limit 20) t
   full join (select * from (select * from ({TOP}) order by score desc, id limit 50) where id in (select id from media)) v on t.id = v.id
   order by text_hit desc, case when t.id is not null then t.id end, score desc, coalesce(t.id, v.id) limit 50) join media using (id) left join
  (select id, case when a is not null then format('[Audio @{{:.1f}}s] {{}}', a.start_s, a.text) else format('[Video @{{:.1f}}s] {{}}', v.start_s, v.text) end as snippet from
    (select id, min(case when kind = 'audio' then {{'pos': pos, 'start_s': start_s, 'text': text}} end) as a, min(case when kind = 'video' then {{'pos': pos, 'start_s': start_s, 'text': text}} end) as v
     from seg where contains(lower(text), 'thing') group by id)) using (id)""", "media", "seg")
def v3_hybrid_search(spark, sf_dir):
    index = text_index.SegmentIndex.build(view(spark, sf_dir, "seg"))
    found = similarity.hybrid_search(view(spark, sf_dir, "media"), vectors(spark, sf_dir), index, "thing", query_vector(spark, sf_dir))
    return found.withColumn("score", rounded("score"))


PAIRS = f"""select a.id as id_a, b.id as id_b, {DOT.format(a='a.u', b='b.u')} as similarity from (select id, {UNIT.format(v='embedding')} as u from jit) a,
  (select id, {UNIT.format(v='embedding')} as u from jit) b where a.id < b.id"""


@query(f"select id_a, id_b, round(similarity, 6) as similarity from ({PAIRS}) where similarity > 0.95 and similarity <= 0.9999", "jit")
def v4_similar_pairs(spark, sf_dir):
    return similarity.similar_pairs(view(spark, sf_dir, "jit")).withColumn("similarity", rounded("similarity"))


@query(f"select count(*) as exact_pairs, 0::bigint as wrong_pairs, true as recall_reached from ({PAIRS}) where similarity > 0.95 and similarity <= 0.9999", "jit")
def v4_similar_pairs_approximate(spark, sf_dir):
    """Of the approximate mode: pairs that the exact one lacks or scores otherwise, and whether it finds 99 % of its pairs."""
    rows = view(spark, sf_dir, "jit")
    exact = tables.written(similarity.similar_pairs(rows), "exact-pairs")
    near = similarity.similar_pairs_approximate(rows, rows=256).withColumnRenamed("similarity", "near")
    both = exact.join(near.hint("merge"), ["id_a", "id_b"], "full_outer")
    found = F.count_if(F.col("near").isNotNull() & F.col("similarity").isNotNull())
    wrong = F.count_if(F.col("near").isNotNull() & (F.col("similarity").isNull() | (F.abs(F.col("near") - F.col("similarity")) > 1e-9)))
    return both.agg(F.count("similarity").alias("exact_pairs"), wrong.alias("wrong_pairs"), (found >= 0.99 * F.count("similarity")).alias("recall_reached"))


@query(f"select id_a, id_b, round(similarity, 6) as similarity from ({PAIRS}) where similarity > 0.9999", "jit")
def v5_exact_copies(spark, sf_dir):
    return similarity.exact_copies(view(spark, sf_dir, "jit")).withColumn("similarity", rounded("similarity"))


@query("select file_hash, count(*) as n, min(id) as first_id from media group by file_hash having count(*) > 1", "media")
def v5_same_fingerprint(spark, sf_dir):
    return similarity.same_fingerprint(view(spark, sf_dir, "media"))


# ---- tagging ---------------------------------------------------------------------------------------

@query("""with v as (select i, concat('tag_', i::varchar) as name, [0, 1, 3, 4][i % 4 + 1] as category from range(20) t(i)),
  h as (select vec_id as id, i, replace(name, '_', ' ') as name, category from embeddings, v where ((vec_id * 31 + i * 17) % 100) / 100 > 0.35)
  select vec_id as id, coalesce((select string_agg(name, '|' order by i) from h where h.id = vec_id and category = 4), '') as character_tags,
   coalesce((select string_agg(name, '|' order by i) from h where h.id = vec_id and category = 3), '') as series_tags from embeddings""")
def t1_decode_tags(spark, sf_dir):
    preds = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.transform(F.sequence(F.lit(0), F.lit(19)), lambda i: ((F.col("vec_id") * 31 + i * 17) % 100) / 100).alias("preds"))
    out = tagging.decode_tags(preds, vocabulary(spark, sf_dir))
    return out.select("id", F.array_join("character_tags", "|").alias("character_tags"), F.array_join("series_tags", "|").alias("series_tags"))


LABELS = CENTROIDS.format(by="label", v="embedding::double[]", where="")


@query(f"""with c as (select * from {LABELS}), s as (select vec_id as id, category, {DOT.format(a='e.embedding', b='c.embedding')} as score from embeddings e, c),
  r as (select *, row_number() over (partition by id order by score desc, category) as rank from s)
  select vec_id as id, coalesce((select string_agg(concat('tag', category::varchar), '|' order by rank) from r where r.id = vec_id and rank <= 5 and score >= 0.05), '') as tags from embeddings""")
def t2_suggest_tags(spark, sf_dir):
    anchors = tagging.train_centroids(vectors(spark, sf_dir), "label").select(F.col("label").alias("tag_idx"), F.concat(F.lit("tag"), F.col("label").cast("string")).alias("tag"), "embedding")
    return tagging.suggest_tags(vectors(spark, sf_dir).select("id", "embedding"), anchors, threshold=0.05).select("id", F.array_join("tags", "|").alias("tags"))


@query(f"select category, {VSUM.format(v='embedding')} as weight from {CENTROIDS.format(by='label', v=UNIT.format(v='embedding'), where='')}")
def t3_prompt_centroid(spark, sf_dir):
    return tagging.prompt_centroid(vectors(spark, sf_dir), "label").select(F.col("label").alias("category"), vector_sum("embedding").alias("weight"))


@query(f"""select vec_id as id, case when {DOT.format(a='embedding', b='(select embedding from embeddings where vec_id = 0)')} > {DOT.format(a='embedding', b='(select embedding from embeddings where vec_id = 1)')}
  then 'photo' else 'illustration' end as style from embeddings""")
def t4_classify_binary(spark, sf_dir):
    rows = table(spark, sf_dir, "embeddings").filter("vec_id in (0, 1)").orderBy("vec_id").collect()
    return tagging.classify_binary(vectors(spark, sf_dir), rows[0]["embedding"], rows[1]["embedding"])


@query(f"select category, {VSUM.format(v='embedding')} as weight from {LABELS}")
def t5_train_centroids(spark, sf_dir):
    return tagging.train_centroids(vectors(spark, sf_dir), "label").select(F.col("label").alias("category"), vector_sum("embedding").alias("weight"))


@query(f"""with c as (select * from {LABELS}), e as (select vec_id, {UNIT.format(v='embedding')} as embedding from embeddings), s as (select vec_id as id, category, {DOT.format(a='e.embedding', b='c.embedding')} as score from e, c),
  r as (select * from s qualify row_number() over (partition by id order by score desc, category) = 1)
  select id, case when score >= 0.25 then category end as category, case when score >= 0.25 then round(score, 6) end as similarity from r""")
def t6_classify(spark, sf_dir):
    centroids = tagging.train_centroids(vectors(spark, sf_dir), "label").select(F.col("label").alias("category"), F.col("label").alias("ord"), "embedding")
    return tagging.classify(vectors(spark, sf_dir).select("id", "embedding"), centroids).withColumn("similarity", rounded("similarity"))


@query("""select vec_id, video_id, style, case when style = 'illustration' then concat('c', (vec_id % 5)::varchar) else '' end as character_tags, case when style = 'illustration' then concat('s', (vec_id % 3)::varchar) else '' end as series_tags
  from frames""", "frames")
def t7_gate(spark, sf_dir):
    def scorer(df):
        tag = lambda name, n: F.array(F.concat(F.lit(name), (F.col("id") % n).cast("string")))
        return df.select("id", tag("c", 5).alias("character_tags"), tag("s", 3).alias("series_tags"))

    out = tagging.gate(view(spark, sf_dir, "frames").withColumnRenamed("vec_id", "id"), "style", scorer)
    return out.select(F.col("id").alias("vec_id"), "video_id", "style", F.array_join("character_tags", "|").alias("character_tags"), F.array_join("series_tags", "|").alias("series_tags"))


CLUSTERS = f"""with recursive jit as materialized ({{jit}}), u as materialized (select id, {UNIT.format(v='embedding')} as u from jit),
  near as materialized (select a.id as a, b.id as b from u a, u b where a.id <> b.id and {DOT.format(a='a.u', b='b.u')} >= 1 - 0.65 * 0.65 / 2),
  core as materialized (select id from u where (select count(*) from near where a = id) + 1 >= 4),
  edge as materialized (select a, b from near where a in (select id from core) and b in (select id from core)),
  reach(id, label) as (select id, id from core union select e.b, r.label from reach r join edge e on e.a = r.id where r.label < e.b),
  lab as (select id, min(label) as label from reach group by id), num as (select label, row_number() over (order by label) - 1 as cluster from (select distinct label from lab)),
  cores as (select id, cluster from lab join num using (label)), out as (select u.id, coalesce((select cluster from cores c where c.id = u.id), (select min(cluster) from near join cores c on c.id = b where a = u.id), -1)::int as cluster_id from u) """


def _clusters_sql(tail: str) -> str:
    from vistalake.plans.views import duck

    return CLUSTERS.replace("{jit}", duck("jit")) + tail


def c1_dbscan(spark, sf_dir):
    return clustering.dbscan(view(spark, sf_dir, "jit").select("id", "embedding"))


def c2_cluster_summary(spark, sf_dir):
    return clustering.cluster_summary(c1_dbscan(spark, sf_dir))


QUERIES |= {"c1_dbscan": c1_dbscan, "c2_cluster_summary": c2_cluster_summary}
ORACLE |= {"c1_dbscan": _clusters_sql("select id, cluster_id from out"),
           "c2_cluster_summary": _clusters_sql("select count(distinct case when cluster_id >= 0 then cluster_id end) as n_clusters, count(*) filter (cluster_id >= 0) as n_clustered, count(*) filter (cluster_id < 0) as n_noise from out")}


@query("select vec_id as id, case when vec_id % 3 = 0 then vec_id % 7 else vec_id % 2 - 1 end::int as cluster_id from embeddings")
def j6_assign_clusters(spark, sf_dir):
    rows = vectors(spark, sf_dir)
    faces = rows.select("id", (F.col("id") % 2 - 1).cast("int").alias("cluster_id"))
    return clustering.assign_clusters(faces, rows.filter("id % 3 = 0").select("id", (F.col("id") % 7).cast("int").alias("cluster_id")))


# ---- frames ----------------------------------------------------------------------------------------

@query("""with k as (select id, n, case when n > ten then ten else 0 end as a, (n // 4) as b, (n * 2 // 4) as c, (n * 3 // 4) as d, case when n > ten then n - ten else n - 1 end as e
   from (select vec_id as id, vec_id * 37 % 2000 as n, floor(10 * (24.0::double + vec_id % 7))::bigint as ten from embeddings))
  select id, array_to_string(list_transform(list_sort(list_distinct([a, b, c, d, e])), lambda i: greatest(0, least(i, n - 1))), ',') as frames from k""")
def m1_keyframes(spark, sf_dir):
    videos = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), (F.col("vec_id") * 37 % 2000).alias("n"), (F.lit(24.0) + F.col("vec_id") % 7).alias("fps"))
    return videos.select("id", F.array_join(frames.keyframe_indices(F.col("n"), F.col("fps")), ",").alias("frames"))


@query("select vec_id as id, round(case when vec_id % 4 > 0 then vec_id / (vec_id % 4 * 7.5) else 0 end, 6)::double as seconds from embeddings")
def m2_seconds(spark, sf_dir):
    fps = (F.col("vec_id") % 4 * 7.5).cast("double")
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), rounded(frames.seconds(F.col("vec_id").cast("double"), fps)).alias("seconds"))


@query(f"""with m as (select * from {CENTROIDS.format(by='(vec_id // 5)', v='embedding::double[]', where='')})
  select video_id, coalesce({VSUM.format(v='embedding')}, 0.0) as weight from (select distinct conv_id as video_id from conversations) left join m on video_id = category""")
def m3_pool_frames(spark, sf_dir):
    videos = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("video_id")).distinct()
    rows = view(spark, sf_dir, "frames").join(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"), "vec_id")
    return frames.pool_frames(videos, rows, 64).select("video_id", vector_sum("embedding").alias("weight"))


@query("""with n as (select video_id, style, count(*) as n, min(frame_no) as seen from frames group by all), b as (select * from n qualify row_number() over (partition by video_id order by n desc, seen) = 1)
  select v.video_id, coalesce(style, 'illustration') as style from (select distinct conv_id as video_id from conversations) v left join b on v.video_id = b.video_id""", "frames")
def m4_majority(spark, sf_dir):
    videos = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("video_id")).distinct()
    return frames.majority(videos, view(spark, sf_dir, "frames"))


@query("select video_id, coalesce(string_agg(array_to_string(tags, '|'), '|' order by frame_no), '') as tags from frames join tags on vec_id = id group by video_id", "frames", "tags")
def m5_concat_tags(spark, sf_dir):
    rows = view(spark, sf_dir, "frames").join(view(spark, sf_dir, "tags"), F.col("vec_id") == F.col("id"))
    return frames.concat_frame_tags(rows, "tags").select("video_id", F.array_join("tags", "|").alias("tags"))


@query("""with m as (select id, coalesce(tags, []) as old, ['sky', 'cat', 'cat', 'new'] as new, case when id % 2 = 0 then 'sky' else 'photo' end as style, character_tags, case when id % 3 = 0 then ['x'] when id % 3 = 1 then []::varchar[] end as chars from tags),
  n as (select *, list_concat(old, list_filter(new, lambda x: not list_contains(old, x))) as merged from m)
  select id, array_to_string(case when list_contains(merged, style) then merged else list_append(merged, style) end, '|') as tags, coalesce(array_to_string(coalesce(chars, character_tags), '|'), '-') as characters from n""", "tags")
def m6_merge_tags(spark, sf_dir):
    new = F.array(*[F.lit(x) for x in ("sky", "cat", "cat", "new")])
    style = F.when(F.col("id") % 2 == 0, "sky").otherwise("photo")
    chars = F.when(F.col("id") % 3 == 0, F.array(F.lit("x"))).when(F.col("id") % 3 == 1, F.array().cast("array<string>"))
    return view(spark, sf_dir, "tags").select("id", F.array_join(frames.merge_tags(F.col("tags"), new, style), "|").alias("tags"), joined(frames.overwrite(F.col("character_tags"), chars)).alias("characters"))


@query("""select vec_id as id, len(embedding)::int as size, concat(vec_id::varchar, ',', (vec_id + 1)::varchar) as bbox, (vec_id % 100) / 100.0::double as det_score,
  case when vec_id % 3 = 0 then 0.0 else vec_id * 0.5 end::double as timestamp, concat(vec_id::varchar, ',1') as kps from embeddings""")
def m7_face_structs(spark, sf_dir):
    raw = F.array(F.struct("embedding", F.array(F.col("vec_id"), F.col("vec_id") + 1).alias("bbox"), ((F.col("vec_id") % 100) / 100).alias("det_score"),
                           F.when(F.col("vec_id") % 3 != 0, F.col("vec_id") * 0.5).alias("timestamp"), F.array(F.array(F.col("vec_id"), F.lit(1))).alias("kps")))
    rows = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.inline(frames.face_structs(raw)))
    return rows.select("id", F.size("embedding").alias("size"), F.concat_ws(",", F.transform("bbox", lambda x: x.cast("string"))).alias("bbox"), "det_score", "timestamp",
                       F.concat_ws(",", F.transform(F.get("kps", F.lit(0)), lambda x: x.cast("int").cast("string"))).alias("kps"))


@query("select id, count(*) filter (pos % 3 <> 0) as kept, coalesce(string_agg(pos::varchar, ',' order by pos) filter (pos % 3 <> 0), '') as positions from seg group by id", "seg")
def m8_clean_descriptions(spark, sf_dir):
    shown = F.when(F.col("pos") % 3 == 0, F.concat(F.lit("Error: "), F.col("text"))).otherwise(F.concat(F.lit("ok "), F.col("text")))
    rows = view(spark, sf_dir, "seg").groupBy("id").agg(F.array_sort(F.collect_list(F.struct("pos", shown.alias("text")))).alias("s"))
    kept = rows.select("id", frames.clean_descriptions(F.col("s")).alias("s"))
    return kept.select("id", F.size("s").cast("bigint").alias("kept"), F.array_join(F.transform("s", lambda x: x["pos"].cast("string")), ",").alias("positions"))


# ---- text ------------------------------------------------------------------------------------------

@query("select id, file_path from media where media_type = 'video' and id in (select id from seg where contains(lower(text), 'thing')) order by id limit 20", "media", "seg")
def x1_text_hits(spark, sf_dir):
    index = text_index.SegmentIndex.build(view(spark, sf_dir, "seg"))
    return text.text_hits(view(spark, sf_dir, "media"), index.matching("Thing"), "Thing").select("id", "file_path")


@query("""select id, case when a is not null then format('[Audio @{:.1f}s] {}', a.start_s, a.text) else format('[Video @{:.1f}s] {}', v.start_s, v.text) end as snippet from
    (select id, min(case when kind = 'audio' then {'pos': pos, 'start_s': start_s, 'text': text} end) as a, min(case when kind = 'video' then {'pos': pos, 'start_s': start_s, 'text': text} end) as v
     from seg where contains(lower(text), 'thing') group by id)""", "seg")
def x2_snippets(spark, sf_dir):
    return text.snippets(view(spark, sf_dir, "seg"), "THING")


@query("select id, kind, (row_number() over (partition by id, kind order by pos) - 1)::int as pos, start_s, case when kind = 'audio' then start_s + 5 end as end_s, text from seg", "seg")
def x3_segments(spark, sf_dir):
    listed = lambda kind, *fields: F.transform(F.array_sort(F.collect_list(F.when(F.col("kind") == kind, F.struct("pos", "start_s", "text")))), lambda x: F.struct(*[f(x) for f in fields]))
    nested = view(spark, sf_dir, "seg").groupBy("id").agg(
        listed("audio", lambda x: x["start_s"].alias("start"), lambda x: (x["start_s"] + 5).alias("end"), lambda x: x["text"].alias("text")).alias("audio_transcription"),
        listed("video", lambda x: x["start_s"].alias("timestamp"), lambda x: x["text"].alias("text")).alias("frame_descriptions"))
    return text.segments_table(nested)


# ---- duplicates ------------------------------------------------------------------------------------

PREFIX = "list_max(list_transform(range(0, least(len(a), len(b)) + 1), lambda i: case when a[1:i] = b[1:i] then i else 0 end))"


@query(f"""with p as (select vec_id as id, concat('img_', (vec_id % 9)::varchar, case when vec_id % 4 = 0 then '_big' else '' end) as a,
   case vec_id % 5 when 0 then concat('img_', (vec_id % 8)::varchar) when 1 then concat('imx', vec_id::varchar) when 2 then 'img_' when 3 then 'img (12)' else concat('img_p', (vec_id % 3)::varchar) end as b from embeddings),
  q as (select *, {PREFIX} as n from p), r as (select *, a[n + 1:] as ra, b[n + 1:] as rb from q)
  select id, len(a) >= 3 and len(b) >= 3 and n >= 3 and (ra = '' or regexp_matches(ra, '^(?i:[_ \\-p\\(r]*[0-9]+[\\)]*)$')) and (rb = '' or regexp_matches(rb, '^(?i:[_ \\-p\\(r]*[0-9]+[\\)]*)$')) as sequential from r""")
def d1_is_sequential(spark, sf_dir):
    v = F.col("vec_id")
    text_of = lambda c: c.cast("string")
    a = F.concat(F.lit("/lib/img_"), text_of(v % 9), F.when(v % 4 == 0, "_big").otherwise(""), F.lit(".jpg"))
    b = (F.when(v % 5 == 0, F.concat(F.lit("img_"), text_of(v % 8))).when(v % 5 == 1, F.concat(F.lit("imx"), text_of(v))).when(v % 5 == 2, "img_").when(v % 5 == 3, "img (12)")
         .otherwise(F.concat(F.lit("img_p"), text_of(v % 3))))
    return table(spark, sf_dir, "embeddings").select(v.alias("id"), duplicates.is_sequential(a, F.concat(F.lit("/other/"), b, F.lit(".png"))).alias("sequential"))


def media_of_jit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """media for the ids of jit, with names that form no series; copies differ in size and time."""
    copies = view(spark, sf_dir, "jit").select(F.col("id").alias("jid"))
    rows = copies.join(view(spark, sf_dir, "media").withColumnRenamed("id", "mid").hint("merge"), F.col("jid") % 1000000 == F.col("mid"))
    k = F.floor(F.col("jid") / 1000000)
    grid = F.transform(F.sequence(F.lit(0), F.lit(71)), lambda i: (F.col("mid") * 37 + i * i) % 256)
    return rows.select(
        F.col("jid").alias("id"), F.concat(F.lit("/lib/"), F.substring(F.md5(F.col("jid").cast("string")), 1, 12), F.lit(".jpg")).alias("file_path"), "media_type",
        (F.col("file_size") + k * 10).cast("bigint").alias("file_size"), (F.col("created_at") - k).alias("created_at"), "width", (F.col("height") + F.when(F.col("mid") % 3 == 0, k * 100).otherwise(0)).cast("bigint").alias("height"),
        "duration", "is_processed", F.when(F.col("jid") % 19 != 0, dhash(grid)).alias("dhash"))


MEDIA_OF_JIT = """mj as materialized (select j.id, concat('/lib/', md5(j.id::varchar)[1:12], '.jpg') as file_path, media_type, file_size + k * 10 as file_size, created_at - k as created_at, width,
   height + case when m.id % 3 = 0 then k * 100 else 0 end as height, duration, is_processed, j.id % 19 <> 0 as hashed
  from (select id, id // 1000000 as k from jit) j join media m on j.id % 1000000 = m.id)"""
SIDE_BY_SIDE = f"""{MEDIA_OF_JIT}, pairs as materialized ({PAIRS}), near as (select * from pairs where similarity > 0.95 and similarity <= 0.9999),
  both_sides as (select n.*, a.media_type as ta, b.media_type as tb, a.duration as da, b.duration as db, a.file_size as fa, b.file_size as fb, a.created_at as ca, b.created_at as cb,
   a.width as wa, b.width as wb, a.height as ha, b.height as hb, a.hashed as xa, b.hashed as xb from near n join mj a on a.id = id_a join mj b on b.id = id_b where a.is_processed and b.is_processed)"""


def sides(spark: SparkSession, sf_dir: str) -> DataFrame:
    return duplicates.similar_with_sides(view(spark, sf_dir, "jit"), media_of_jit(spark, sf_dir))


@query(f"""select * from (with {SIDE_BY_SIDE} select id_a, id_b, ta = tb and (ta <> 'video' or (abs(coalesce(da, 0) - coalesce(db, 0)) <= 2 and similarity >= 0.98)) as compatible from both_sides)""", "media", "jit")
def d2_pair_compatible(spark, sf_dir):
    return sides(spark, sf_dir).select("id_a", "id_b", duplicates.pair_compatible(F.col("similarity")).alias("compatible"))


GRID = "list_transform(range(0, 64), lambda i: case when (({id} * 37 + (i // 8 * 9 + i % 8 + 1) * (i // 8 * 9 + i % 8 + 1)) % 256) > (({id} * 37 + (i // 8 * 9 + i % 8) * (i // 8 * 9 + i % 8)) % 256) then '1' else '0' end)"
HEX = "array_to_string(list_transform(range(0, 16), lambda h: '0123456789abcdef'[1 + list_sum(list_transform(range(0, 4), lambda j: case when g[h * 4 + j + 1] = '1' then (8 >> j::int) else 0 end))::int]), '')"


@query(f"select id, {HEX} as dhash from (select vec_id as id, {GRID.format(id='vec_id')} as g from embeddings)")
def d3_dhash(spark, sf_dir):
    grid = F.transform(F.sequence(F.lit(0), F.lit(71)), lambda i: (F.col("vec_id") * 37 + i * i) % 256)
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), dhash(grid).alias("dhash"))


@query(f"""select id, case when id % 7 = 0 then 999 else list_sum(list_transform(list_zip(g, lead), lambda z: case when z[1] <> z[2] then 1 else 0 end)) end::int as distance from
  (select vec_id as id, {GRID.format(id='vec_id')} as g, {GRID.format(id='(vec_id + 1)')} as lead from embeddings)""")
def d4_hamming(spark, sf_dir):
    grid = lambda n: F.transform(F.sequence(F.lit(0), F.lit(71)), lambda i: ((F.col("vec_id") + n) * 37 + i * i) % 256)
    rows = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), dhash(grid(0)).alias("a"), F.when(F.col("vec_id") % 7 == 0, "").otherwise(dhash(grid(1))).alias("b"))
    return rows.select("id", hamming(F.col("a"), F.col("b")).alias("distance"))


@query(f"""select * from (with {SIDE_BY_SIDE}, g as (select id, {GRID.format(id='(id % 1000000)')} as g from mj)
  select id_a, id_b, ta <> 'image' or (xa and xb and list_sum(list_transform(list_zip(a.g, b.g), lambda z: case when z[1] <> z[2] then 1 else 0 end)) <= 8) as passes
  from both_sides join g a on a.id = id_a join g b on b.id = id_b)""", "media", "jit")
def d5_hash_gate(spark, sf_dir):
    return sides(spark, sf_dir).select("id_a", "id_b", duplicates.hash_gate(F.col("dhash_a"), F.col("dhash_b")).alias("passes"))


ADVICE = """case when wa * ha > wb * hb * 1.05 then concat('keep_a|Resolution A (', wa, 'x', ha, ') > B (', wb, 'x', hb, ')') when wb * hb > wa * ha * 1.05 then concat('keep_b|Resolution B (', wb, 'x', hb, ') > A (', wa, 'x', ha, ')')
  when fa > fb * 1.05 then concat('keep_a|File Size A (', fa // 1024, 'KB) > B (', fb // 1024, 'KB)') when fb > fa * 1.05 then concat('keep_b|File Size B (', fb // 1024, 'KB) > A (', fa // 1024, 'KB)')
  when ca < cb then 'keep_a|A is older (likely original)' else 'keep_b|B is older (likely original)' end"""


@query(f"select * from (with {SIDE_BY_SIDE} select id_a, id_b, {ADVICE} as advice from both_sides)", "media", "jit")
def d6_recommend(spark, sf_dir):
    advice = sides(spark, sf_dir).select("id_a", "id_b", duplicates.recommend().alias("r"))
    return advice.select("id_a", "id_b", F.concat_ws("|", "r.action", "r.reason").alias("advice"))


@query(f"""select * from (with {SIDE_BY_SIDE}, g as (select id, file_path, {GRID.format(id='(id % 1000000)')} as g from mj)
  select id_a, id_b, round(similarity, 6) as similarity, split_part({ADVICE}, '|', 1) as action, split_part({ADVICE}, '|', 2) as reason from both_sides join g a on a.id = id_a join g b on b.id = id_b
  where ta = tb and (ta <> 'video' or (abs(coalesce(da, 0) - coalesce(db, 0)) <= 2 and similarity >= 0.98))
   and (ta <> 'image' or (xa and xb and list_sum(list_transform(list_zip(a.g, b.g), lambda z: case when z[1] <> z[2] then 1 else 0 end)) <= 8)))""", "media", "jit")
def d7_find_duplicates(spark, sf_dir):
    found = duplicates.find_duplicates(media_of_jit(spark, sf_dir), view(spark, sf_dir, "jit"))
    return found.withColumn("similarity", rounded("similarity"))


# ---- organising ------------------------------------------------------------------------------------

ITEMS = """items as (select id, concat('/lib/', (id % 7)::varchar, '/f', (id % 50)::varchar, '.jpg') as file_path, created_at, id % 23 <> 0 as present, concat('re:zero /', (id % 3)::varchar, '?') as category from media),
  n as (select *, concat('/dest/re_zero _', (id % 3)::varchar, '_/') as folder, concat('f', (id % 50)::varchar) as stem from items),
  t as (select *, row_number() over (partition by folder, stem, present order by id) as turn, id % 50 = 7 as taken from n),
  s as (select *, row_number() over (partition by folder, stem, floor(created_at), (taken or turn > 1), present order by id) - 1 as again from t),
  plan as (select id, file_path as source, case when present then case when taken or turn > 1 then concat(folder, stem, '_', floor(created_at)::bigint::varchar, case when again > 0 then concat('_', again::varchar) else '' end, '.jpg')
   else concat(folder, stem, '.jpg') end end as dest, present as success from s)"""


def items_and_existing(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    text_of = lambda c: c.cast("string")
    items = view(spark, sf_dir, "media").select(
        "id", F.concat(F.lit("/lib/"), text_of(F.col("id") % 7), F.lit("/f"), text_of(F.col("id") % 50), F.lit(".jpg")).alias("file_path"), "created_at", "modified_at",
        (F.col("id") % 23 != 0).alias("present"), F.concat(F.lit("re:zero /"), text_of(F.col("id") % 3), F.lit("?")).alias("category"))
    existing = view(spark, sf_dir, "media").select(F.concat(F.lit("/dest/re_zero _"), text_of(F.col("id") % 3), F.lit("_/f7.jpg")).alias("path")).distinct()
    return items, existing


@query(f"select * from (with {ITEMS} select id, source, dest, success from plan)", "media")
def o1_sort_plan(spark, sf_dir):
    items, existing = items_and_existing(spark, sf_dir)
    return organize.sort_plan(items, "/dest/", F.col("category"), existing).select("id", "source", "dest", "success")


@query(f"""select * from (with {ITEMS} select -id as seq, 'move' as op, dest as source, source as dest, concat('MOVED: ', source, ' -> ', dest) as line from plan where success)""", "media")
def o2_undo_and_log(spark, sf_dir):
    items, existing = items_and_existing(spark, sf_dir)
    plan = organize.sort_plan(items, "/dest", F.col("category"), existing, "move")
    log = organize.operation_log(plan).select((-F.col("seq")).alias("seq"), "line")
    return organize.undo_plan(plan).join(log, "seq").select("seq", "op", "source", "dest", "line")


@query("""select count(*) as matched, count(*) as processed, concat('Processed ', count(*)::varchar, ' files') as message from catalog
  where is_processed and error_msg is null and len(list_filter(tags, lambda x: contains(lower(x), 'document'))) > 0""", "catalog")
def o3_organize(spark, sf_dir):
    existing = view(spark, sf_dir, "media").select(F.concat(F.lit("/dest/docs/"), F.col("id").cast("string")).alias("path"))
    return organize.organize(catalog(spark, sf_dir), "tag", "document", "/dest", "docs", existing)[1]


@query("""with m as (select id, file_path, created_at, split_part(split_part(file_path, '/', -1), '.', 1) as stem, split_part(file_path, '.', -1) as ext, id % 4 = 0 as held from catalog
   where is_processed and error_msg is null and created_at >= epoch(timestamp '2024-01-01') and created_at <= epoch(timestamp '2024-12-31 23:59:59'))
  select id, file_path as source, concat('/dest/2024/', stem, case when held then concat('_', floor(created_at)::bigint::varchar) else '' end, '.', ext) as dest, 'move' as operation, true as success from m""", "catalog")
def o3_plan(spark, sf_dir):
    existing = view(spark, sf_dir, "media").filter("id % 4 = 0").select(F.concat(F.lit("/dest/2024/"), F.regexp_extract("file_path", "([^/]*)$", 1)).alias("path"))
    return organize.organize(catalog(spark, sf_dir), "year", "2024", "/dest", "2024", existing, "move")[0]


@query("select media_type as category, count(*) as n, sum(file_size)::bigint as bytes from media group by 1", "media")
def o4_write_by_category(spark, sf_dir):
    path = tables.fresh_path(spark, "by-category")
    tables.write_by_category(view(spark, sf_dir, "media").withColumnRenamed("media_type", "category"), path)
    return tables.load(spark, path).groupBy(F.col("category").cast("string").alias("category")).agg(F.count(F.lit(1)).alias("n"), F.sum("file_size").alias("bytes"))


# ---- scoring, progress, streaming --------------------------------------------------------------------

@query("""select doc_id, case when doc_id % 97 = 5 then null else length(text) % 10 / 10.0 end::double as score, doc_id % 97 <> 5 as success,
  case when doc_id % 97 = 5 then concat('bad item ', doc_id::varchar) end as error_msg from documents""")
def b1_b2_score_batches(spark, sf_dir):
    def make_model():
        def model(frame: pd.DataFrame) -> pd.DataFrame:
            bad = frame.loc[frame["doc_id"] % 97 == 5, "doc_id"]
            if len(bad):
                raise ValueError(f"bad item {bad.iloc[0]}")
            return pd.DataFrame({"doc_id": frame["doc_id"], "score": frame["size"] % 10 / 10.0})

        return model

    docs = table(spark, sf_dir, "documents").select("doc_id", F.length("text").alias("size"))
    return scoring.score_batches(docs, make_model, "doc_id long, score double")


@query("""select scan_id, event_id, row_number() over w as current, count(*) over (partition by scan_id) as total, sum(newly) over w::bigint as newly_processed,
  round((epoch_us(ts) - min(epoch_us(ts)) over w) / 1e6, 3) as elapsed, round((count(*) over (partition by scan_id) - row_number() over w) * ((epoch_us(ts) - min(epoch_us(ts)) over w) / 1e6) / row_number() over w, 3) as eta,
  round(row_number() over w / count(*) over (partition by scan_id) * 100, 4) as percent from scanlog window w as (partition by scan_id order by ts, event_id rows between unbounded preceding and current row)""", "scanlog")
def b3_progress(spark, sf_dir):
    rows = progress.progress(view(spark, sf_dir, "scanlog"))
    return rows.select("scan_id", "event_id", "current", "total", "newly_processed", rounded("elapsed", 3).alias("elapsed"), rounded("eta", 3).alias("eta"), rounded("percent", 4).alias("percent"))


@query("select scan_id, sum(newly)::bigint as processed, count(*) as scanned from scanlog group by scan_id", "scanlog")
def b3_summary(spark, sf_dir):
    return progress.summary(view(spark, sf_dir, "scanlog"))


@query("""select path as file_path, md5(path) as file_hash, true as is_processed from manifest where regexp_matches(lower(path), '\\.(jpg|jpeg|png|webp|bmp|mp4|avi|mov|mkv|webm)$') and not regexp_matches(path, '/\\.[^/]*/')""", "manifest")
def b4_stream_ingest(spark, sf_dir):
    from vistalake.streaming.ingest import latest, stream_ingest

    source, target = tables.fresh_path(spark, "stream-source"), tables.fresh_path(spark, "stream-catalog")
    rows = view(spark, sf_dir, "manifest").withColumn("file_hash", F.md5("path"))
    rows.unionByName(rows.filter("vec_id % 5 = 0")).repartition(3).write.parquet(source)  # overlapping paths in three files
    empty = spark.createDataFrame([], "file_path string, file_hash string, is_processed boolean, error_msg string")

    def score(fresh):
        return fresh.select("file_path", "file_hash", F.lit(True).alias("success"), F.lit(None).cast("string").alias("error_msg"), F.lit(1).alias("seq"))

    stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(source)
    stream_ingest(spark, stream, target, tables.fresh_path(spark, "stream-progress"), empty, score, buckets=8).awaitTermination()
    return latest(spark, target).select("file_path", "file_hash", "is_processed")


@query(f"""select path as file_path, length as file_size, vec_id % 3 as n_faces, {VSUM.format(v=UNIT.format(v='embedding'))} as weight, row_number() over (order by path) as place from manifest join embeddings using (vec_id)
  where regexp_matches(lower(path), '\\.(jpg|jpeg|png|webp|bmp|mp4|avi|mov|mkv|webm)$') and not regexp_matches(path, '/\\.[^/]*/')""", "manifest")
def b4_stream_vectors(spark, sf_dir):
    from vistalake.streaming.ingest import latest, stream_ingest

    source, target = tables.fresh_path(spark, "stream-source"), tables.fresh_path(spark, "stream-tables")
    rows = view(spark, sf_dir, "manifest").join(table(spark, sf_dir, "embeddings").select("vec_id", "embedding").hint("merge"), "vec_id")
    first = rows.withColumn("file_hash", F.lit("old")).withColumn("embedding", F.transform("embedding", lambda x: -x))
    for version in (first.filter("vec_id % 5 = 0"), rows.withColumn("file_hash", F.md5("path"))):  # a fifth of the files change
        version.coalesce(1).write.mode("append").parquet(source)
    empty = spark.createDataFrame([], "id long, file_path string, file_hash string, file_size long, is_processed boolean, error_msg string")

    def score(fresh):
        n = F.when(F.col("file_hash") == "old", 2).otherwise((F.col("vec_id") % 3).cast("int"))
        return fresh.select("file_path", "file_hash", F.col("length").cast("long").alias("file_size"), F.lit(True).alias("success"), F.lit(None).cast("string").alias("error_msg"), F.lit(1).alias("seq"),
                            "embedding", F.array_repeat("embedding", n).alias("face_vectors"), F.array().cast("array<struct<timestamp:double>>").alias("faces"))

    stream = spark.readStream.schema(first.schema).option("maxFilesPerTrigger", 1).parquet(source)
    stream_ingest(spark, stream, target, tables.fresh_path(spark, "stream-progress"), empty, score, compact=2, buckets=8).awaitTermination()
    files, vecs, faces = (latest(spark, target, name) for name in ("catalog", "vectors", "faces"))
    counts = faces.groupBy(F.col("file_id").alias("id")).agg(F.countDistinct("id").alias("n_faces"))
    out = files.join(vecs.hint("merge"), "id").join(counts.hint("merge"), "id", "left")
    place = clustering.numbered(out.select("file_path"), "file_path").select("file_path", (F.col("number") + 1).alias("place"))
    return out.join(place.hint("merge"), "file_path").select("file_path", "file_size", F.coalesce("n_faces", F.lit(0)).cast("bigint").alias("n_faces"), vector_sum("embedding").alias("weight"), "place")

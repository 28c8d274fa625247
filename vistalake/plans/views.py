"""Media-shaped views derived from the test tables, in SQL that Spark and DuckDB both run ({S}: the string type)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

MEDIA = """select vec_id as id,
  concat('/lib/', cast(vec_id % 7 as {S}), '/img_', cast(vec_id as {S}),
    case when vec_id % 5 = 0 then '.mp4' when vec_id % 11 = 0 then '.PNG' else '.jpg' end) as file_path,
  md5(concat('h', cast(vec_id - vec_id % 2 as {S}))) as file_hash,
  1000 + (vec_id * 7919) % 100000 as file_size,
  case when vec_id % 5 = 0 then 'video' else 'image' end as media_type,
  cast(1700000000 + (vec_id * 86400) % 63072000 as double) as created_at,
  cast(1700000000 + (vec_id * 86400) % 63072000 as double) as modified_at,
  cast(640 + 320 * (vec_id % 5) as bigint) as width, cast(480 + 240 * (vec_id % 3) as bigint) as height,
  case when vec_id % 5 = 0 then cast(30 + vec_id % 90 as double) end as duration,
  vec_id % 13 <> 0 as is_processed,
  case when vec_id % 17 = 0 then 'Load Error: x' end as error_msg, label
from embeddings"""

TAGS = """select vec_id as id,
  case vec_id % 4 when 0 then split('sunset,sky', ',') when 1 then split('cat', ',') when 3 then split('document,text,Sky', ',') end as tags,
  case vec_id % 6 when 0 then split('alice w,bob', ',') when 2 then split('Alice W', ',') when 4 then split('bob', ',') end as character_tags,
  case vec_id % 3 when 0 then split('re:zero', ',') when 1 then split('wonder', ',') end as series_tags
from embeddings"""

SEG = """select conv_id as id, case when role = 'user' then 'audio' else 'video' end as kind,
  cast(turn as bigint) as pos, cast(turn * 7 + 0.5 as double) as start_s, text
from conversations where role in ('user','assistant')"""

FRAMES = """select cast(floor(vec_id / 5) as bigint) as video_id, vec_id % 5 as frame_no, vec_id,
  case when (vec_id * 7) % 3 = 0 then 'photo' else 'illustration' end as style
from embeddings"""

SCANLOG = """select cast(user_id % 5 as bigint) as scan_id, event_id, ts,
  case when event_type in ('click','view','purchase') then 1 else 0 end as newly
from events"""

MANIFEST = """select concat('/lib/', case when vec_id % 9 = 0 then '.cache/' when vec_id % 8 = 0 then 'sorted/' else 'a/' end,
  'f', cast(vec_id as {S}),
  case vec_id % 6 when 0 then '.JPG' when 1 then '.mp4' when 2 then '.txt' when 3 then '.png' when 4 then '.WebM' else '.bmp' end) as path,
  500 + vec_id * 37 as length, vec_id
from embeddings"""

SQL = {"media": MEDIA, "tags": TAGS, "seg": SEG, "frames": FRAMES, "scanlog": SCANLOG, "manifest": MANIFEST}
SOURCE = {"seg": "conversations", "scanlog": "events"}

#: Every vector and three jittered copies of it (id + 1000000 * k), so that there are near duplicates and clusters.
JIT_SPARK = """select vec_id + 1000000 * k as id, label, case when k = 0 then cast(embedding as array<double>) else
  transform(cast(embedding as array<double>), (x, i) -> x + (case when vec_id % 10 = 9 then 0.0D else 0.004D * (1 + vec_id % 4) end) * ((((vec_id * 31 + i * 17 + k * 5) % 7) - 3))) end as embedding
from embeddings lateral view explode(array(0, 1, 2, 3)) t as k"""
JIT_DUCK = """select vec_id + 1000000 * k as id, label, case when k = 0 then embedding::double[] else
  list_transform(embedding::double[], lambda x, i: x + (case when vec_id % 10 = 9 then 0.0::double else 0.004::double * (1 + vec_id % 4) end) * ((((vec_id * 31 + (i - 1) * 17 + k * 5) % 7) - 3))) end as embedding
from embeddings, (select unnest([0, 1, 2, 3]) as k)"""


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    source = SOURCE.get(name, "embeddings")
    text = (JIT_SPARK if name == "jit" else SQL[name].replace("{S}", "string")).replace(f"from {source}", "from {source}")
    return spark.sql(text, source=table(spark, sf_dir, source))


def duck(name: str) -> str:
    return JIT_DUCK if name == "jit" else SQL[name].replace("{S}", "varchar")


def catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    """media with its tag arrays."""
    return view(spark, sf_dir, "media").join(view(spark, sf_dir, "tags"), "id")


def with_views(query: str, *names: str) -> str:
    """DuckDB SQL with the named views in front; `catalog` is media with tags."""
    need = list(dict.fromkeys(x for n in names for x in (("media", "tags", "catalog") if n == "catalog" else (n,))))
    parts = [f"{n} as ({'select media.*, tags, character_tags, series_tags from media join tags using (id)' if n == 'catalog' else duck(n)})" for n in need]
    head = f"with {', '.join(parts)}"
    return f"{head}, {query[5:]}" if query.startswith("with ") else f"{head} {query}"

"""Table schemas known by name, and registration of tables as views."""

from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import DataFrame, SparkSession
from pyspark.util import inheritable_thread_target

from .sources.csv import read_csv
from .types import LogicalType, schema

# The 21 tables of the movie schema. A name followed by ":s" is a string, every other column a 32-bit integer.
MOVIE_TABLES = {
    "aka_name": "id person_id name:s imdb_index:s name_pcode_cf:s name_pcode_nf:s surname_pcode:s md5sum:s",
    "aka_title": "id movie_id title:s imdb_index:s kind_id production_year phonetic_code:s episode_of_id season_nr episode_nr note:s md5sum:s",
    "cast_info": "id person_id movie_id person_role_id note:s nr_order role_id",
    "char_name": "id name:s imdb_index:s imdb_id name_pcode_nf:s surname_pcode:s md5sum:s",
    "comp_cast_type": "id kind:s",
    "company_name": "id name:s country_code:s imdb_id name_pcode_nf:s name_pcode_sf:s md5sum:s",
    "company_type": "id kind:s",
    "complete_cast": "id movie_id subject_id status_id",
    "info_type": "id info:s",
    "keyword": "id keyword:s phonetic_code:s",
    "kind_type": "id kind:s",
    "link_type": "id link:s",
    "movie_companies": "id movie_id company_id company_type_id note:s",
    "movie_info": "id movie_id info_type_id info:s note:s",
    "movie_info_idx": "id movie_id info_type_id info:s note:s",
    "movie_keyword": "id movie_id keyword_id",
    "movie_link": "id movie_id linked_movie_id link_type_id",
    "name": "id name:s imdb_index:s imdb_id gender:s name_pcode_cf:s name_pcode_nf:s surname_pcode:s md5sum:s",
    "person_info": "id person_id info_type_id info:s note:s",
    "role_type": "id role:s",
    "title": "id title:s imdb_index:s kind_id production_year imdb_id phonetic_code:s episode_of_id season_nr episode_nr series_years:s md5sum:s",
}


def movie_schema(table: str):
    return schema(*((c.removesuffix(":s"), LogicalType.VARCHAR if c.endswith(":s") else LogicalType.INT32) for c in MOVIE_TABLES[table].split()))


class Catalog(dict):
    """DataFrames by table name."""

    @classmethod
    def parquet(cls, spark: SparkSession, folder: str, names: list[str]) -> Catalog:
        """Tables ``folder/name.parquet``; their schemas are read side by side."""
        read = inheritable_thread_target(spark)(lambda n: spark.read.parquet(f"{folder}/{n}.parquet"))
        with ThreadPoolExecutor(max(1, min(8, len(names)))) as pool:
            return cls(zip(names, pool.map(read, names), strict=True))

    @classmethod
    def movie_csv(cls, spark: SparkSession, folder: str, names: list[str] | None = None, multi_line: bool = True) -> Catalog:
        """The movie tables from ``folder/name.csv``, a file or a folder of files; without ``multi_line`` large files are split."""
        return cls({n: read_csv(spark, f"{folder}/{n}.csv", movie_schema(n), multi_line=multi_line) for n in names or MOVIE_TABLES})

    def views(self) -> Catalog:
        """Registers every table as a temporary view for ``spark.sql``."""
        for name, df in self.items():
            df.createOrReplaceTempView(name)
        return self

    def of(self, name: str) -> DataFrame:
        if name not in self:
            raise KeyError(f"no table named {name}")
        return self[name]

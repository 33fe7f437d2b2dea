from __future__ import annotations

import os
import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parent.parent
sys.path.insert(0, str(ROOT))
os.environ["PYTHONPATH"] = f"{ROOT}:{os.environ.get('PYTHONPATH', '')}"

DATA = Path("/root/testdata")


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from pyspark.sql import SparkSession

    from docforge.functions.session import prepared

    s = (
        SparkSession.builder.master("local[4]").config("spark.sql.shuffle.partitions", "4").config("spark.driver.memory", "4g").config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false").config("spark.checkpoint.dir", f"file://{tmp_path_factory.mktemp('shared')}").getOrCreate()
    )
    s.sparkContext.setLogLevel("ERROR")
    yield prepared(s)
    s.stop()


CHANGE_REQUESTS = (
    "cr_id long, extracted_index string, spec string, current_version string, meeting_id string, title string, reason_for_change string, summary_of_change string, consequences_if_not_approved string, "
    "clauses_affected array<string>, other_specs_affected array<string>, date string, change_list array<string>, table_modified_flag boolean, page_count int, figure_modified_flag boolean, other_comments string, "
    "source string, source_to_wg string, source_to_tsg string, work_item_code string, category string, lang string, data_split string, gold_response string, response_text string, ingested_at timestamp"
)
OTHERS = {
    "documents": "doc_id long, text string, lang string, source string, n_chars long, doc_kind string, spec string, added_at timestamp",
    "level_labels": "doc_id long, rater string, level int, labelled_at timestamp",
    "specs": "spec string, spec_title string, series int, tech_domain string, lead_wg string",
    "sources": "source string, home_zone string, date_order string",
    "eval_items": "item_id long, testset string, lang string, text string",
    "size_limits": "limit_name string, unit string, max_size int, overlap_size int",
}


class Tables:
    """Small tables written as parquet; rows are dicts, missing fields are null."""

    def __init__(self, spark, folder):
        self.spark, self.folder = spark, str(folder)

    def write(self, extra: bool = False, **tables):
        from pyspark.sql import functions as F

        for name, schema in {"change_requests": CHANGE_REQUESTS, **OTHERS}.items():
            fields = [f.split()[0] for f in schema.replace("array<string>", "array").split(", ")]
            rows = [tuple(r.get(f) for f in fields) for r in tables.get(name, [])]
            df = self.spark.createDataFrame(rows, schema)
            if extra:  # columns with names that operators use for themselves
                for c in ("text", "key", "n", "rank", "role", "size", "block", "at", "seed", "band", "value", "tech_domain", "home_zone", "original", "revised", "level"):
                    if c not in df.columns:
                        df = df.withColumn(c, F.lit("clash"))
            df.write.mode("overwrite").parquet(f"{self.folder}/{name}.parquet")
        return self.folder


@pytest.fixture()
def tables(spark, tmp_path):
    return Tables(spark, tmp_path)


SOURCES = [{"source": "Penhallow Radio", "home_zone": "Europe/London", "date_order": "DMY"}, {"source": "Harrowgate Wireless", "home_zone": "America/New_York", "date_order": "MDY"}, {"source": "Lanyue Mobile", "home_zone": "Asia/Shanghai", "date_order": "YMD"}]

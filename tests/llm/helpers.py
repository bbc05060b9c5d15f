"""Plain-Python versions of what the operators compute, and small fixtures."""

import re

WORD = re.compile(r"[^\x20\x09-\x0D]+")

DOC_SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def words(text):
    return WORD.findall(text or "")


def docs(spark, rows):
    """rows: (doc_id, text[, lang[, source]])"""
    full = [(*r, *([None] * (4 - len(r)))) for r in rows]
    return spark.createDataFrame([(i, t, lang, s, len(t or "")) for i, t, lang, s in full], DOC_SCHEMA)


def write_tables(spark, folder, **tables):
    for name, df in tables.items():
        df.write.mode("overwrite").parquet(f"{folder}/{name}.parquet")
    return str(folder)


def documents(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/documents.parquet").toPandas()

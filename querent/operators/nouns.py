"""Noun candidates and their filter on rows: a row a token, and names as a dictionary to join."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from querent.functions.text import filter_reason, is_noun_tag, is_plain, schema_name, strip


def candidates(tokens: DataFrame) -> DataFrame:
    """(text_id, place, candidate, phrase) of tokens (text_id, pos, token, tag).

    Nouns, and runs of two or more neighbouring ones as phrases; positions of a
    text follow one another.  In a run the difference of a noun's position and
    its number among the text's nouns stays the same, which tells runs apart.  A
    phrase comes after its nouns; candidates that repeat count where they first
    occur.  All steps are by text, so rows are dealt once.  The same candidates as ``noun_candidates`` gives for an array.
    """
    nouns = tokens.filter(is_noun_tag(F.col("tag"))).select("text_id", "pos", strip(F.col("token")).alias("token")).filter("token <> ''")
    runs = nouns.withColumn("run", F.col("pos") - F.expr("row_number() OVER (PARTITION BY text_id ORDER BY pos)"))
    own = runs.groupBy("text_id", "run").agg(F.array_sort(F.collect_list(F.struct("pos", "token"))).alias("own"))
    each = F.transform("own", lambda x: F.struct(x["pos"].alias("pos"), x["token"].alias("candidate"), F.lit(False).alias("phrase")))
    whole = F.array(F.struct(F.element_at("own", -1)["pos"].alias("pos"), F.array_join(F.transform("own", lambda x: x["token"]), " ").alias("candidate"), F.lit(True).alias("phrase")))
    every = own.select("text_id", F.explode(F.when(F.size("own") >= 2, F.concat(each, whole)).otherwise(each)).alias("c")).select("text_id", "c.*")
    first = every.groupBy("text_id", "candidate").agg(F.min(F.struct("pos", "phrase")).alias("at"))
    place = F.expr("row_number() OVER (PARTITION BY text_id ORDER BY at.pos, at.phrase)") - 1
    return first.select("text_id", place.alias("place"), "candidate", F.col("at.phrase").alias("phrase"))


def variants(names: DataFrame) -> DataFrame:
    """(db_id, variant) of names (db_id, name): the texts that are taken for one of a database's names."""
    return names.filter("name IS NOT NULL").select("db_id", F.explode(F.array(F.lower("name"), schema_name(F.col("name")))).alias("variant")).distinct()


def kept(nouns: DataFrame, names: DataFrame) -> DataFrame:
    """The rows of stripped nouns (db_id, noun, ...) that stay, by the names (db_id, name) of their databases.

    Only nouns that no other reason drops are looked up.  The same nouns as
    ``is_kept`` keeps with an array of names.
    """
    known = variants(names).withColumnRenamed("db_id", "_d")
    out = nouns.filter(is_plain(F.col("noun")))
    for form in (F.lower("noun"), schema_name(F.col("noun"))):
        out = out.join(known, (F.col("db_id") == F.col("_d")) & (form == F.col("variant")), "left_anti")
    return out


def reasons(nouns: DataFrame, names: DataFrame) -> DataFrame:
    """(db_id, noun, reason) of the different nouns (db_id, noun), by the names (db_id, name) of their databases.

    Names are a dictionary of their variants that nouns are joined with by
    database and text, however many a database has.  The same reasons as
    ``filter_reason`` gives with an array of names.
    """
    once = nouns.select("db_id", "noun").distinct()
    stripped = strip(F.col("noun"))
    forms = once.select("db_id", "noun", F.explode(F.array_distinct(F.array(F.lower(stripped), schema_name(stripped)))).alias("variant"))
    named = forms.join(variants(names), ["db_id", "variant"], "left_semi").select("db_id", "noun").distinct().withColumn("named", F.lit(True))
    out = once.join(named, ["db_id", "noun"], "left")
    return out.select("db_id", "noun", filter_reason(F.col("noun"), named=F.coalesce("named", F.lit(False))).alias("reason"))

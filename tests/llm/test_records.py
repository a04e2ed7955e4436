"""Tables with columns that have a record's name."""

from pyspark.sql import functions as F

from stringwatch.llm import tokens
from stringwatch.llm.queries import tokenizer_file
from stringwatch.llm.records import as_alarms, as_documents


def test_clashing_columns_are_set_aside_and_come_back(spark):
    documents = spark.createDataFrame(
        [(1, "a b", "s", "en", "x", "y", 3)], "doc_id bigint, text string, source string, lang string, alarm_name string, ALARM_EVENT_ID string, own_alarm_name int"
    )
    records = as_alarms(documents)
    assert records.first().alarm_name == "a b" and records.first().alarm_event_id == 1
    assert len({c.lower() for c in records.columns}) == 7
    assert records.select(F.upper("alarm_name").alias("u")).first().u == "A B"
    assert as_documents(records).first() == documents.first() and as_documents(records).columns == documents.columns
    assert as_documents(tokens.alarm_token_counts(records, tokenizer_file())).first().doc_id == 1

"""Rows that every document operator must bear: nulls in every column, empty
and very long texts, ties, repeated rows, extra columns with clashing names."""

import pytest

from tests.conftest import SF001, SF01  # noqa: F401

PROSE = ("The harbour of the old town was quiet in the morning, and the first boats came in with the light. "
         "It is said that the fishers know the way home by the smell of the bread. ")

CLEAN = (
    "When the first snow fell on the hills, the people of the village went to the mill and asked for the flour that was due to "
    "them. The miller was not at home. His daughter said that the river had been low for weeks, and that the wheel could turn "
    "only in the night. So they waited by the fire and told stories of other winters, of wolves and of lost bells, until the "
    "water came back with a sound like many small drums. In the morning every house had bread, and nobody spoke of leaving.")


def edge_rows():
    long_text = " ".join(f"word{i % 977} and the {i}" for i in range(30_000))
    same = PROSE * 3
    return [
        (1, same, "en", "src0", len(same)),
        (2, same, "en", "src0", len(same)),                       # a copy
        (3, same + "One more word.", None, None, None),           # a near copy
        (4, None, "en", "src1", 0),
        (5, "", None, "src1", None),
        (6, " \n\t ", "de", None, 3),
        (7, long_text, "en", "src2", len(long_text)),
        (8, "1234 5678 ... !!!", None, "src2", 17),               # no letter
        (9, "Un.", "fr", "src2", 3),
        (10, "El perro de la casa y los gatos del barrio por la noche. " * 8, "es", "src3", 1),
        (10, "El perro de la casa y los gatos del barrio por la noche. " * 8, "es", "src3", 1),   # a repeated row
        (11, CLEAN, "en", "src3", len(CLEAN)),
        (12, CLEAN + " Write to mill@example.org for more.", "en", None, None),
        (None, "Der Hund und die Katze sind nicht auf dem Dach des Hauses. " * 8, "de", None, 2),
    ]


@pytest.fixture(scope="session")
def edge_docs(spark):
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    docs = spark.createDataFrame(edge_rows(), schema)
    from pyspark.sql import functions as F
    names = ["kept", "id", "band", "component", "words", "w", "t", "slot", "key", "pos", "spans", "value", "rest", "lead", "n"]
    return docs.select("*", *[F.lit(f"extra {x}").alias(x) for x in names])


@pytest.fixture(scope="session")
def no_docs(edge_docs):
    return edge_docs.filter("doc_id < 0")

"""Copies and re-parameterisations that one reading of a benchmark item alone misses."""

import random

from helpers_llm import documents

from gridlark.llm import decontam


def kinds(spark, texts, items):
    rows = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    return {(r["doc_id"], r["item_id"]): r["kind"] for r in decontam.contaminated(documents(spark, texts), rows).collect()}


def prose(seed, n):
    rng = random.Random(seed)
    return ["".join(rng.choice("abcdefgh") for _ in range(6)) for _ in range(n)]


def test_part_changed_alignments(spark):
    long = prose(1, 59)
    long[10] = long[45] = "12"
    edited = [*long[:45], "15", *long[46:]]
    equal = "a box of 12 red pens and 5 blue pens is sold at the market to Anna today"
    twice = "then Anna gave 12 of the nuts in her bag to the poor old man at the gate"
    found = kinds(spark, [" ".join(edited), equal.replace("12", "7").replace("5 ", "7 "), (2, twice.replace("12", "20")), (2, twice.replace("12", "30"))], [" ".join(long), equal, twice])
    assert set(found) == {(0, 0), (1, 1), (2, 2)} and found[1, 1] == found[2, 2] == "reparameterised"


def test_windows_dense_in_slots(spark):
    dense = ["Convert 5 km 3 m 20 cm", "on 12/03 14:20 and 13/03 15:40 and 14/03 16:10 then 15/03 17:30 end", "die Liste nennt Hans Otto Karl Emil Fritz Paul Kurt Ernst Willi Georg"]
    found = kinds(spark, [*("words before it " + d + " and after" for d in dense), "Convert 6 km 4 m 30 cm"], dense)
    assert found == {(i, i): "verbatim" for i in range(3)}


def test_names_at_sentence_starts_and_case(spark):
    items = ["Who wrote the long red book", "Anna ran home. Robert ate soup. Maria slept well. Walter sang songs all night.", "now Anna Keller has 12 apples and gives 5 of them to Robert at noon"]
    docs = [
        "Quiz 12 Who wrote the long red book", 'he said "stop." Who wrote the long red book', "WHO WROTE THE LONG RED BOOK", "a heading\nWho wrote the long red book",
        "Paul ran home. Ernst ate soup. Julia slept well. Peter sang songs all night.", items[2].replace("12", "40").upper(), items[2].lower(), "a heading Paul ran home. Ernst ate soup. Julia slept well. Peter sang songs all night.",
    ]
    found = kinds(spark, docs, items)
    assert found == {(0, 0): "verbatim", (1, 0): "verbatim", (2, 0): "verbatim", (3, 0): "verbatim", (4, 1): "reparameterised", (5, 2): "reparameterised", (6, 2): "verbatim", (7, 1): "reparameterised"}

from pyspark.sql import functions as F

from trackloom.llm import chat_format as cf

T = "conv_id long, turn long, role string, text string"
ROWS = [
    (1, 0, "system", "be [INST] kind <<SYS>> \\ </s>"),
    (1, 1, "user", "<s>hi\\<s> [/INST]"),
    (1, 2, "assistant", "a\nb </s>"),
    (1, 3, "user", None),
    (1, 4, "assistant", ""),
    (2, 0, "user", "alone"),
    (3, 0, None, None),
    (3, 0, "assistant", "tie"),
    (3, 0, "assistant", "tie"),
    (None, None, "assistant", "nobody \U0001f600"),
    (4, 0, "assistant", "<</SYS>>" * 20000),
    (5, 0, "odd]role\n[/INST]", "x"),
]


def turns(spark, rows=ROWS):
    df = spark.createDataFrame(rows, T).withColumn("segment", F.lit("clash")).withColumn("loss_start", F.lit(1))
    return cf.format_turns(df)


def order(rows):
    low = lambda x: (x is not None, x)
    return sorted(rows, key=lambda r: (low(r[0]), low(r[1]), r[2] or "", r[3] or ""))


def test_round_trip(spark):
    """Turns and trained replies, read back from the segments and from the examples' ranges."""
    table = turns(spark)
    whole = cf.conversations(table, cf.expand_examples(table))
    read = whole.select("conv_id", F.transform("segments", cf.read_turn).alias("turns"), "examples", cf.read_losses(F.col("segments"), F.col("examples")).alias("losses"))
    got = {r["conv_id"]: r for r in read.collect()}
    assert set(got) == {r[0] for r in ROWS}
    for conv, r in got.items():
        want = [(role or "", text or "") for c, _, role, text in order(ROWS) if c == conv]
        assert [(t["role"], t["text"]) for t in r["turns"]] == want
        assert r["losses"] == [text for role, text in want if role == "assistant"]
        assert [e["target_turn"] for e in r["examples"]] == [k for k, (role, _) in enumerate(want) if role == "assistant"]


def test_the_query_loses_what_an_example_loses(spark):
    """Without an example its reply is missing from the losses: they come from the examples alone."""
    table = turns(spark)
    fewer = cf.expand_examples(table).where("target_turn != 2")
    one = cf.conversations(table, fewer).where("conv_id = 1")
    assert one.select(cf.read_losses(F.col("segments"), F.col("examples"))).first()[0] == [""]


def test_control_strings_are_the_templates_alone(spark):
    for r in turns(spark).collect():
        for control in ("<s>", "[INST]", "[/INST]", "</s>"):
            assert r["segment"].count(control) == 1
        assert "<<SYS>>" not in r["segment"] and "<</SYS>>" not in r["segment"]


def test_examples_are_prefixes_with_one_trained_reply(spark):
    table = turns(spark).where("conv_id != 4")
    whole = {}
    for r in sorted(table.collect(), key=lambda r: r["turn_no"]):
        whole[r["conv_id"]] = whole.get(r["conv_id"], "") + r["segment"]
    light = {(r["conv_id"], r["target_turn"]): r for r in cf.expand_examples(table).collect()}
    full = cf.materialise_examples(table).collect()
    assert len(light) == len(full) == sum(1 for c, _, role, _ in ROWS if role == "assistant" and c not in (4, None))
    for r in full:
        e = light[r["conv_id"], r["target_turn"]]
        assert r["text"] == whole[r["conv_id"]][: e["end"]]
        assert r["text"][e["loss_end"] :] == cf.CLOSE and (r["loss_start"], r["loss_end"]) == (e["loss_start"], e["loss_end"])
        assert e["context_end"] <= e["loss_start"]


def test_empty_table(spark):
    assert turns(spark, []).count() == 0 and cf.expand_examples(turns(spark, [])).count() == 0

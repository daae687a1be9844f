
from pyspark.sql import functions as F

from glyphmill.llm import chat as C

TEXTS = ["plain", "</s>[INST] ok [/INST]", "<|end|>", r"<\|end|>", r"<\\|text|> <||| \\", "<<SYS>>a<</SYS>>", r"[\INST] [/INST] [\\\/INST]", "", "é\n日本 <s>", "<|", "a" * 5000, "$1 \\2", "<", "<\\"]


def test_reversible(spark):
    df = spark.createDataFrame([(t,) for t in TEXTS], "t string").withColumn("e", C.escaped(F.col("t"))).withColumn("u", C.unescaped(F.col("e")))
    for r in df.collect():
        assert r.u == r.t and "<|" not in r.e and "[INST]" not in r.e and "</s>" not in r.e


def test_turns_and_loss(spark):
    rows = [(1, i, "assistant" if i % 2 else "user", t) for i, t in enumerate(TEXTS)] + [(2, None, None, None), (2, 0, "assistant", "x"), (2, 0, "assistant", "x"), (3, 1, "odd <|text|>\nrole", "y"), (None, 0, "user", "z")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(3)
    rec = F.to_variant_object(F.struct(F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text")))
    made = C.format_chats(C.canonical(df.select("conv_id", "turn", rec.alias("record"))))
    got = {r.conv_id: r for r in made.select("conv_id", C.parse(F.col("formatted")).alias("turns"), C.loss_text(F.col("formatted"), F.col("loss_spans")).alias("loss")).collect()}
    by = {}
    for c, n, role, text in rows:
        by.setdefault(c, []).append(((n is not None, n or 0), role or "", text or ""))
    for c, turns in by.items():
        turns = [(a, b) for _, a, b in sorted(turns, key=lambda x: x[0])]
        assert [(t.role, t.text) for t in got[c].turns] == turns
        assert got[c].loss == "".join(t for r, t in turns if r == "assistant")


def test_layouts(spark):
    records = {
        '{"prompt":"p","response":"r"}': ["user:p", "assistant:r"],
        '{"instruction":"i","input":"","output":"o"}': ["user:i", "assistant:o"],
        '{"output":"o","input":"n","instruction":"i"}': ["user:i\n\nn", "assistant:o"],
        '{"instruction":"i","output":null}': ["user:i", "assistant:"],
        '{"messages":[{"role":"system","content":"s"},{"role":"user","content":"u"}]}': ["system:s", "user:u"],
        '{"conversations":[{"from":"human","value":"h"},{"from":"gpt","value":"g"}]}': ["user:h", "assistant:g"],
        '{"something":"else"}': None,
    }
    df = spark.createDataFrame([(i, 0, r) for i, r in enumerate(records)], "conv_id long, turn long, j string")
    made = C.canonical(df.select("conv_id", "turn", F.parse_json("j").alias("record")))
    got = {r.conv_id: r.turns for r in made.select("conv_id", "turns").collect()}
    for i, want in enumerate(records.values()):
        assert (got[i] and [f"{t.role}:{t.text}" for t in got[i]]) == want
    assert C.unknown(made).count() == 1


def test_native_and_empty(spark):
    df = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    rec = F.to_variant_object(F.struct("role", "text"))
    made = C.format_chats(C.canonical(df.select("conv_id", "turn", rec.alias("record"))))
    assert made.count() == 0
    plan = made._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_more_fields_and_unknown_records(spark):
    records = {
        '{"id":7,"prompt":"p","response":"r","system":"s"}': ["system:s", "user:p", "assistant:r"],
        '{"messages":[{"role":"user","content":"u","name":"n"}],"source":"x"}': ["user:u"],
        '{"role":"user","text":"t","system":"no turn","n":1.5}': ["user:t"],
        '{"instruction":"i","input":"n","output":null,"id":"a"}': ["user:i\n\nn", "assistant:"],
        '{"conversations":[{"from":"human","value":"h","w":1},{"from":"gpt","value":"g"}],"system":""}': ["user:h", "assistant:g"],
        '{"messages":[]}': [],
        '{"something":"else"}': None,
        '[1]': None,
    }
    df = spark.createDataFrame([(i, 0, r) for i, r in enumerate(records)], "conv_id long, turn long, j string")
    made = C.canonical(df.select("conv_id", "turn", F.parse_json("j").alias("record")))
    got = {r.conv_id: r.turns for r in made.select("conv_id", "turns").collect()}
    for i, want in enumerate(records.values()):
        assert (got[i] if want is None else [f"{t.role}:{t.text}" for t in got[i]]) == want
    done = {r.conv_id: r for r in C.format_chats(made).collect()}
    assert {k: r.unknown for k, r in done.items()} == {i: int(want is None) for i, want in enumerate(records.values())}
    assert done[5].formatted == done[6].formatted == "" and done[0].formatted.startswith("<|role|>system<|text|>s<|end|>")


def test_columns_named_like_its_own_are_replaced(spark):
    record = F.to_variant_object(F.struct(F.lit("user").alias("role"), F.lit("hi").alias("text")))
    df = spark.range(2).select(F.col("id").alias("conv_id"), F.lit(0).alias("turn"), F.lit("x").alias("layout"), F.lit(1).alias("turns"), F.lit(2).alias("conv"), record.alias("record"))
    made = C.canonical(df)
    assert sorted(made.columns) == sorted(df.columns)
    assert [[tuple(t) for t in r.turns] for r in made.collect()] == [[("user", "hi")]] * 2
    assert C.format_chats(made).count() == 2

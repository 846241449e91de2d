import duckdb
import pandas as pd

from graphloom.llm.chat import MOST, ORACLE, PART, rotate


def brute(rows, part_turns):
    out = {}
    convs = {}
    for conv, turn, role, text in rows:
        convs.setdefault(conv, []).append((turn is not None, turn or 0, role or "unknown", text or ""))
    for conv, turns in convs.items():
        turns.sort()
        for who in sorted({r for _, _, r, _ in turns} - {"system"}):
            at = 0
            for has, turn, role, text in turns:
                head = "<|assistant|>\n" if role == who else "<|system|>\n" if role == "system" else f"<|user name={role}|>\n"
                line = f"{head}{text}<|end|>\n"
                key = (conv, who, turn // part_turns if has else -1)
                start, body, mask, n = out.get(key, (at, "", [], 0))
                if role == who:
                    mask = [*mask, f"{at + len(head)}:{at + len(line) - 1}"]
                out[key] = (start, body + line, mask, n + 1)
                at += len(line)
    return {k: (s, b, ",".join(m), n, len(m)) for k, (s, b, m, n) in out.items()}


def test_rotation(spark):
    rows = [
        (1, 0, "system", "be kind"), (1, 1, "ann", "hi"), (1, 2, "bob", "hé"), (1, 3, "ann", None), (1, 3, "ann", None), (1, None, "cy", "late"),
        (2, 0, "user", "one"), (2, 1, None, "two"), (2, 2, "", "three"), (None, 0, "x", "alone"), (3, 0, "system", "only"),
    ]
    rows += [(4, i, "ab"[i % 2], f"t{i}") for i in range(11)]
    df = spark.createDataFrame([(*r, "extra") for r in rows], "conv_id long, turn long, role string, text string, part string")
    for size in (4, 128):
        got = {(r.conv_id, r.speaker, r.part): (r.start, r.text, r["mask"], r.n_turns, r.n_masked) for r in rotate(df, part_turns=size).collect()}
        assert got == brute(rows, size)
        for (conv, who, part), (start, text, mask, *_) in got.items():
            for span in filter(None, mask.split(",")):
                a, b = map(int, span.split(":"))
                assert text[a - start : b - start].endswith("<|end|>")
    assert rotate(df.limit(0)).count() == 0


def test_overfull_parts(spark):
    """Null turns, one number over and over, equal rows, and rows without a conversation, more than a task should gather."""
    rows = [(7, None, "ann" if i % 3 else "bob", f"n{i % 400}") for i in range(900)]
    rows += [(7, 5, "bob", "same")] * 700 + [(7, i, "cy", f"t{i}") for i in range(300)]
    rows += [(None, i % 2, "xé" if i % 5 else "system", "hello" if i % 7 else None) for i in range(1500)]
    rows += [(8, i, "ab"[i % 2], "é" * (i % 9)) for i in range(140)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = rotate(df)
    con = duckdb.connect()
    con.register("conversations", pd.DataFrame(rows, columns=["conv_id", "turn", "role", "text"]).astype({"conv_id": "Int64", "turn": "Int64"}))
    found = con.execute(ORACLE)
    columns = [c[0] for c in found.description]
    assert sorted(map(str, found.fetchall())) == sorted(str(tuple(r)) for r in got.select(*columns).collect())
    assert got.agg({"n_turns": "max"}).first()[0] <= MOST
    assert got.filter("conv_id = 7 and part = 0 and speaker = 'bob'").agg({"n_turns": "sum"}).first()[0] == 700 + PART
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Pandas" not in plan and "Arrow" not in plan


def test_other_keys(spark):
    """Conversations named by texts, and a long turn."""
    rows = [("a", 0, "x", "y" * 300_000), ("a", 1, "z", "ok"), (None, 0, "x", "?"), ("", 0, "x", "!")]
    got = {(r.conv_id, r.speaker): (r.n_turns, len(r.text)) for r in rotate(spark.createDataFrame(rows, "conv_id string, turn int, role string, text string")).collect()}
    assert set(got) == {("a", "x"), ("a", "z"), (None, "x"), ("", "x")} and got["a", "x"][1] > 300_000 and got[None, "x"][0] == 1


def test_native_plan(spark):
    df = spark.createDataFrame([(1, 0, "a", "x")], "conv_id long, turn long, role string, text string")
    plan = rotate(df)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Pandas" not in plan and "Arrow" not in plan

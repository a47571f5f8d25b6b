"""URL rules, tool calls and the pipeline."""

import json
import random

from pyspark.sql import functions as F

import corpus_pipeline
from tests.llm.test_text import brute_components
from weftline.llm import decontam, jaccard_join, mix, pii, quality, tool_calls, url_filter


def judge(url, rules):
    """Host, path, rule and verdict by trying every rule."""
    host, path = "", ""
    if url and "://" in url:
        rest = url.split("://", 1)[1]
        n = min([rest.find(c) for c in "/?#" if c in rest] or [len(rest)])
        host, tail = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in rest[:n]), rest[n:]
        path = tail[: min([tail.find(c) for c in "?#" if c in tail] or [len(tail)])]
    hits = [(len(h + p), h + p, v) for h, p, v in rules if host and (host == h or host.endswith("." + h)) and path.startswith(p)]
    return (host, path, *(max(hits)[1:] if hits else (None, "allow")))


def test_url_filter_equals_trying_all_rules(spark):
    rng = random.Random(1)
    names = ["a", "b", "net", "org", "x-y", "a.b", ""]
    rules = list({(".".join(rng.choice(names[:5]) for _ in range(rng.randint(1, 4))), rng.choice(["/", "/a/", "/a/b", "/c"])): rng.choice(["allow", "block"]) for _ in range(60)}.items())
    rules = [(h, p, v) for (h, p), v in rules]
    urls = [rng.choice(["http://", "https://", "", "HTTP://"]) + ".".join(rng.choice(names).upper() if rng.random() < 0.1 else rng.choice(names) for _ in range(rng.randint(1, 5))) + rng.choice(["", "/", "/a/", "/a/b/c", "/c?x=/a", "#/a", "?q://z"]) for _ in range(400)] + [None, "", "no scheme", "://", "http://", "x://net/"]
    urls += ["http://www.net/a/1"] * 300
    df = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string").withColumn("host", F.lit(1))
    got = {r["page_id"]: (r["host"], r["path"], r["rule"], r["verdict"]) for r in url_filter.url_filter(df, url_filter.rule_table(spark, rules)).collect()}
    assert got == {i: judge(u, rules) for i, u in enumerate(urls)}
    none = url_filter.url_filter(df, url_filter.rule_table(spark, []))
    assert {r["verdict"] for r in none.collect()} == {"allow"}
    assert url_filter.url_filter(df.limit(0), url_filter.rule_table(spark, rules)).count() == 0


def test_tool_calls(spark):
    call = lambda *c: json.dumps({"content": "looking", "tool_calls": [{"id": i, "name": n, "arguments": a} for i, n, a in c]})
    rows = [
        (1, 0, "user", "weather?"),
        (1, 1, "assistant", call(("c1", "weather", {"city": "Ulm", "days": 2}), ("c2", "weather", {"days": "two", "x": 1}))),
        (1, 2, "tool", json.dumps({"tool_call_id": "c1", "content": "rain"})),
        (1, 3, "assistant", call(("c1", "nope", {}), ("c3", "search", "no object"))),
        (2, 5, "tool", json.dumps({"tool_call_id": "zz", "content": "lost"})),
        (3, 1, "tool", json.dumps({"tool_call_id": "k", "content": "early"})),
        (3, 4, "assistant", call(("k", "calculator", {"expression": "1+1"}))),
        (4, 0, "user", None), (4, 0, "user", None), (None, None, None, '{"broken'), (4, 1, "user", '{"a": 1}'),
    ]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = tool_calls.link_tool_calls(df, tool_calls.tool_table(spark)).collect()
    assert len(got) == len(rows)
    by = {(r["conv_id"], r["turn"]): r for r in got}
    first = json.loads(by[1, 1]["json"])
    assert first["calls"][0] == {"arguments": {"city": "Ulm", "days": 2}, "faults": [], "id": "c1", "name": "weather", "state": "answered"}
    assert first["calls"][1]["faults"] == ["bad argument days", "bad argument x", "missing argument city"] and first["calls"][1]["state"] == "open"
    second = json.loads(by[1, 3]["json"])
    assert [c["state"] for c in second["calls"]] == ["duplicate", "open"] and second["calls"][0]["faults"] == ["unknown tool"] and second["calls"][1]["faults"] == ["arguments are no object"]
    assert (by[1, 2]["anchor_turn"], by[1, 2]["depth"]) == (1, 1) and json.loads(by[1, 2]["json"])["result_state"] == "linked"
    assert json.loads(by[2, 5]["json"])["result_state"] == "orphan"
    order = sorted((r for r in got if r["conv_id"] == 3), key=lambda r: (r["anchor_turn"], r["depth"], r["turn"]))
    assert [r["turn"] for r in order] == [4, 1]  # the result stands behind its call
    assert json.loads(by[4, 1]["json"])["content"] == '{"a": 1}' and json.loads(by[None, None]["json"])["role"] == "unknown"
    for r in got:
        assert json.dumps(json.loads(r["json"]), sort_keys=True, separators=(",", ":"), ensure_ascii=False) == r["json"]
    assert tool_calls.link_tool_calls(df.limit(0), tool_calls.tool_table(spark)).count() == 0


def test_tool_calls_without_identifier_or_name_stay(spark):
    good = {"id": "c1", "name": "calculator", "arguments": {"expression": "1+1"}}
    other = {"type": "function", "function": {"name": "search", "b": 1, "a": [None, 2.5]}}
    mixed = json.dumps({"thought": {"z": 1, "a": "é"}, "content": "x", "tool_calls": [good, {"name": "calculator", "arguments": {}}, {"id": "c2", "arguments": {"q": 1}, "note": "n"}, other, None]})
    rows = [(1, 0, "assistant", mixed), (1, 1, "tool", json.dumps({"tool_call_id": "c1", "content": "2", "ms": 5})), (1, 2, "tool", json.dumps({"tool_call_id": "c2", "content": "3"})), (None, 3, "assistant", mixed)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = {r["turn"]: r for r in tool_calls.link_tool_calls(df, tool_calls.tool_table(spark)).collect()}
    first = json.loads(got[0]["json"])
    assert (got[0]["n_calls"], got[0]["n_linked"], got[0]["n_faults"]) == (5, 2, 7) and first["extra"] == {"thought": {"z": 1, "a": "é"}}
    assert first["calls"] == [
        {**good, "faults": [], "state": "answered"},
        {"arguments": {}, "faults": ["missing argument expression", "missing identifier"], "name": "calculator", "state": "open"},
        {"arguments": {"q": 1}, "extra": {"note": "n"}, "faults": ["missing name"], "id": "c2", "state": "answered"},
        {"extra": other, "faults": ["missing identifier", "missing name"], "state": "open"},
        {"faults": ["missing identifier", "missing name"], "state": "open"},
    ]
    assert json.loads(got[1]["json"])["extra"] == {"ms": 5} and got[2]["depth"] == 1 and json.loads(got[3]["json"])["content"] == mixed
    for r in got.values():
        assert json.dumps(json.loads(r["json"]), sort_keys=True, separators=(",", ":"), ensure_ascii=False) == r["json"]


def brute_order(messages):
    """(anchor, depth) of each turn by walking dependencies: messages (turn, calls, result_of), calls (id, refs)."""
    first, answered = {}, {r for _, _, r in messages if r}
    for turn, calls, _ in messages:
        for i, _ in calls:
            first.setdefault(i, turn)
    by = {m[0]: m for m in messages}

    def place(turn, seen=()):
        if turn in seen:
            raise RecursionError
        _, calls, result = by[turn]
        if result in first:
            a, d = place(first[result], (*seen, turn))
            return a, d + 1
        at = (turn, 0)
        for _, refs in calls:
            for r in refs:
                if r in first and r in answered:
                    a, d = place(first[r], (*seen, turn))
                    at = max(at, (a, d + 2))
        return at

    return {m[0]: place(m[0]) for m in messages}


def test_order_follows_dependencies(spark):
    rng = random.Random(7)
    rows, want = [], {}
    for conv in range(25):
        n = rng.randint(2, 14)
        turns = rng.sample(range(40), n)
        rank = {t: k for k, t in enumerate(turns)}  # calls refer to calls of a smaller rank, at any turn
        messages = []
        for t in turns:
            if rng.random() < 0.45:
                messages.append((t, [], f"c{rng.choice(turns)}"))
            else:
                messages.append((t, [(f"c{t}", [f"c{x}" for x in rng.sample(turns, rng.randint(0, min(3, n))) if rank[x] < rank[t]])], None))
        messages.sort()
        want |= {(conv, t): p for t, p in brute_order(messages).items()}
        for t, calls, result in messages:
            body = {"tool_call_id": result, "content": "r"} if result else {"tool_calls": [{"id": i, "name": "t", "arguments": {f"a{k}": {"result_of": r} for k, r in enumerate(refs)}} for i, refs in calls]}
            rows.append((conv, t, "x", json.dumps(body)))
    rows += [(99, 0, "x", json.dumps({"tool_calls": [{"id": "p", "name": "t", "arguments": {"a0": {"result_of": "q"}}}]})), (99, 1, "x", json.dumps({"tool_calls": [{"id": "q", "name": "t", "arguments": {"a0": {"result_of": "p"}}}]})), (99, 2, "x", '{"tool_call_id": "p"}'), (99, 3, "x", '{"tool_call_id": "q"}')]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("key", F.lit("clash")).withColumn("calls", F.lit(1))
    tools = spark.createDataFrame([("t", f"a{i}", "integer", False) for i in range(3)] + [("t", "a0", "string", False), ("t", "a0", "integer", False), (None, None, None, None)], "tool string, argument string, type string, required boolean")
    got = tool_calls.link_tool_calls(df, tools).collect()
    assert len(got) == len(rows) and {(r["conv_id"], r["turn"]): (r["anchor_turn"], r["depth"]) for r in got if r["conv_id"] < 99} == want
    assert any(p != (t, 0) and p[1] > 1 for (_, t), p in want.items())
    circle = [json.loads(r["json"])["calls"][0]["faults"] for r in got if r["conv_id"] == 99 and r["turn"] < 2]
    assert circle == [["circular reference"]] * 2


def test_turns_become_calls_and_results(spark):
    rows = [(1, 0, "user", 'say "hi"\n'), (1, 1, "assistant", "hi"), (1, 2, "user", "again"), (2, 0, "system", "s"), (2, 2, "user", "late"), (2, 5, "assistant", "lost"), (3, 0, "user", '{"a":1}'), (None, 0, "user", "x"), (4, 0, "user", None), (5, 0, "user", "w " * 200_000)]
    rows += [(6, t, ("user", "assistant")[t % 2], f"turn {t}") for t in range(8)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = {(r["conv_id"], r["turn"]): r for r in tool_calls.link_tool_calls(tool_calls.from_turns(df), tool_calls.tool_table(spark, tool_calls.TURN_TOOLS)).collect()}
    arguments = lambda *k: json.loads(got[k]["json"])["calls"][0]["arguments"]
    assert len(got) == len(rows) and arguments(1, 2) == {"message": "again", "turn": 2, "after": {"result_of": "4"}} and arguments(6, 4)["turn"] == "4"
    assert got[1, 0]["n_linked"] == 1 and json.loads(got[1, 0]["json"])["calls"][0]["faults"] == ["open reference after"] and json.loads(got[2, 2]["json"])["calls"][0]["faults"] == ["unknown reference after"]
    assert json.loads(got[2, 5]["json"])["result_state"] == "orphan" and got[3, 0]["n_calls"] == 0 and got[None, 0]["n_calls"] == 0 and got[4, 0]["n_calls"] == 1 and got[5, 0]["n_calls"] == 1
    assert [(got[6, t]["anchor_turn"], got[6, t]["depth"]) for t in range(8)] == [(6, 6), (6, 7), (6, 4), (6, 5), (6, 2), (6, 3), (6, 0), (6, 1)]
    assert json.loads(got[6, 4]["json"])["calls"][0]["faults"] == ["bad argument turn"] and [c["state"] for c in json.loads(got[6, 6]["json"])["calls"]] == ["answered", "duplicate"]


def waiting(conv, turn, own, *refs):
    """A message that makes the call ``own`` with references."""
    return (conv, turn, "x", json.dumps({"tool_calls": [{"id": own, "name": "t", "arguments": {f"a{k}": {"result_of": r} for k, r in enumerate(refs)}}]}))


def answer(conv, turn, of):
    return (conv, turn, "x", json.dumps({"tool_call_id": of}))


def linked(spark, rows):
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    tools = spark.createDataFrame([("t", f"a{i}", "integer", False) for i in range(3)], "tool string, argument string, type string, required boolean")
    got = {(r["conv_id"], r["turn"]): r for r in tool_calls.link_tool_calls(df, tools).collect()}
    assert len(got) == len(rows)
    faults = {k: c["faults"] for k, r in got.items() for c in json.loads(r["json"]).get("calls", [])}
    return {k: (r["anchor_turn"], r["depth"]) for k, r in got.items()}, {k for k, f in faults.items() if f == ["circular reference"]}, faults


def test_long_chains_wait_whole(spark):
    n = 100  # each waits for the next, the last for none
    rows = [waiting(1, i, f"c{i}", *([f"c{i + 1}"] if i < n - 1 else [])) for i in range(n)] + [answer(1, n + i, f"c{i}") for i in range(n)]
    places, circular, faults = linked(spark, rows)
    assert not circular and not any(faults.values())
    assert places == {(1, t): ((n - 1, 2 * (n - 1 - t)) if t < n else (n - 1, 2 * (2 * n - 1 - t) + 1)) for t in range(2 * n)}


def test_only_members_of_circles_are_circular(spark):
    rows = []
    # a circle of 5, another of 3 that it waits for, a message between the two, one that hangs on the first, one that waits for itself
    for i in range(5):
        rows.append(waiting(1, i, f"p{i}", f"p{(i + 1) % 5}", *(["between"] if i == 2 else [])))
    rows += [waiting(1, 5, "between", "q0"), waiting(1, 6, "hangs", "p0"), waiting(1, 7, "after", "hangs"), waiting(1, 8, "self", "self"), waiting(1, 9, "q0", "q1"), waiting(1, 10, "q1", "q2"), waiting(1, 11, "q2", "q0")]
    rows += [waiting(1, 12, "free"), waiting(2, 0, "a", "b"), waiting(2, 1, "b")]
    calls = ["p0", "p1", "p2", "p3", "p4", "between", "hangs", "after", "self", "q0", "q1", "q2", "free"]
    rows += [answer(1, 20 + i, c) for i, c in enumerate(calls)] + [answer(2, 20, "a"), answer(2, 21, "b")]
    places, circular, _ = linked(spark, rows)
    assert circular == {(1, t) for t in (0, 1, 2, 3, 4, 8, 9, 10, 11)}
    assert all(places[1, t] == (t, 0) for t in (0, 1, 2, 3, 4, 6, 7, 8, 9, 10, 11, 12)) and places[1, 5] == (9, 2) and places[2, 0] == (1, 2)


def test_pipeline_equals_plain_version(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    model = quality.train(docs, spark.read.parquet(f"{small}/labels.parquet"))
    scores = {r["doc_id"]: r["score"] for r in quality.scored(docs, model).collect()}
    rows = {r["doc_id"]: r for r in docs.collect() if scores[r["doc_id"]] >= quality.THRESHOLD}
    groups = brute_components([(i, r["text"]) for i, r in rows.items()], 5, 80)
    rows = {i: rows[i] for i, _, c in groups if c == i}
    items = [r["text"].lower().split() for r in spark.read.parquet(f"{small}/benchmark.parquet").collect()]
    holds = lambda t: any(" ".join(x) in " ".join(t.lower().split()) for x in items)
    rows = {i: r for i, r in rows.items() if not holds(r["text"])}
    got = corpus_pipeline.run(spark, small).collect()
    assert {r["doc_id"] for r in got} == set(rows)
    text = {i: pii.redact(r["text"], pii.spans(r["text"])) for i, r in rows.items()}
    assert {r["doc_id"]: (r["text"], r["lang"], r["source"], r["n_chars"]) for r in got} == {i: (text[i], r["lang"], r["source"], len(text[i])) for i, r in rows.items()}
    assert {r["doc_id"]: r["size"] for r in got} == {i: len(t.encode().split()) for i, t in text.items()}
    assert all(r["taken"] == r["copies"] * r["size"] for r in got) and 0 < sum(r["taken"] for r in got)


def test_stages_keep_columns_and_take_any_table(spark, small):
    docs = spark.createDataFrame([(1, None, None, None, None), (None, "some text", "en", "a", 9), (2, "", "en", "a", 0), (2, "", "en", "a", 0), (3, "mail a@b.co now", "en", "b", 15), (4, "long word " * 40_000, "en", "b", 400_000)], "doc_id long, text string, lang string, source string, n_chars long")
    for table in (docs, docs.limit(0)):
        for name, stage in corpus_pipeline.STAGES:
            out = stage(spark, table, small)
            out.collect()
            if name != corpus_pipeline.STAGES[-1][0]:
                assert out.columns == corpus_pipeline.COLUMNS
    red = {r["doc_id"]: r for r in corpus_pipeline.pii_stage(spark, docs, small).collect()}
    assert red[3]["text"] == "mail <EMAIL> now" and red[3]["n_chars"] == 16
    assert decontam.contaminated(docs, docs.where("n_chars < 100").selectExpr("doc_id as item_id", "text")).count() >= 0 and mix.mixed(docs).count() == 6


def test_keys_of_sketches_are_on_disk_once(spark, small, monkeypatch):
    """The widest table of the near-duplicate stage is written once, and nothing is a copy of it."""
    wide, stash = [], jaccard_join.stash
    monkeypatch.setattr(jaccard_join, "stash", lambda df: wide.append("keys" in df.columns) or stash(df))
    docs = spark.read.parquet(f"{small}/documents.parquet")
    out = corpus_pipeline.near_duplicate_stage(spark, docs, small)
    assert sum(wide) == 1 and 0 < out.count() < docs.count()

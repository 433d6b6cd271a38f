"""Chat formats, fill-in-middle, importance resampling."""

import hashlib
import json
import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from castwise.llm import chat, fill_middle, resample

SF = "/root/testdata/sf0.001"
ROWS = "conv_id long, turn long, role string, text string, turns int, formatted string"


def digest(text):
    return hashlib.sha256(text.encode()).hexdigest()


LAYOUTS = [
    ({"messages": [{"role": "user", "content": "a"}, {"role": "assistant", "content": "b", "name": "x"}], "id": 7}, "messages", [("user", "a"), ("assistant", "b")]),
    ({"system": "s", "messages": [{"role": "user", "content": None}]}, "messages", [("system", "s"), ("user", "")]),
    ({"messages": [{"role": "user", "content": [{"type": "text", "text": "a"}, {"type": "text", "text": "b"}]}]}, "message_parts", [("user", "ab")]),
    ({"conversations": [{"from": "human", "value": "a"}, {"from": "gpt", "value": "b"}, {"from": "tool", "value": "c"}]}, "conversations", [("user", "a"), ("assistant", "b"), ("tool", "c")]),
    ({"instruction": "i", "input": "x", "output": "o"}, "instruction", [("user", "i\n\nx"), ("assistant", "o")]),
    ({"instruction": "i", "input": "", "output": "o", "meta": {"a b": [1, {"c": 2}]}}, "instruction", [("user", "i"), ("assistant", "o")]),
    ({"output": "o", "instruction": "i"}, "instruction", [("user", "i"), ("assistant", "o")]),
    ({"prompt": "p", "completion": 3}, "prompt_completion", [("user", "p"), ("assistant", "3")]),
    ({"prompt": "p", "response": "r"}, "prompt_response", [("user", "p"), ("assistant", "r")]),
    ({"question": "q", "context": "c", "answer": "a"}, "question_answer", [("user", "c\n\nq"), ("assistant", "a")]),
    ({"messages": []}, "messages", []),
    ({"prompt": "p"}, None, None),
    ({"prompt": "p", "response": "r", "messages": []}, None, None),
    ([1], None, None),
]


def test_layouts_by_fingerprint(spark):
    texts = [json.dumps(r) for r, _, _ in LAYOUTS] + [None, "", "no json"]
    df = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "id int, record string, layout string").drop("layout")
    got = {r.id: r for r in chat.canonical_turns(df).collect()}
    for i, (_, name, turns) in enumerate(LAYOUTS):
        assert got[i].layout == name, LAYOUTS[i]
        assert (None if got[i].turns is None else [tuple(t) for t in got[i].turns]) == turns
    assert all(got[i].layout is None and got[i].turns is None for i in range(len(LAYOUTS), len(texts)))
    assert got[4].fingerprint == got[5].fingerprint != got[6].fingerprint
    assert chat.canonical_turns(df.limit(0)).count() == 0


def test_field_paths(spark):
    text = '{"a":{"b c":null,"d":[[1],[2]]},"e":[{"f":1},{"g":{"h":2.50}}],"`:":true}'
    row = spark.createDataFrame([(text,)], "j string").select(chat.field_paths(F.parse_json("j")).alias("p")).first()
    assert sorted(row.p) == sorted(["a.`b c`", "a.d[][]", "e[].f", "e[].g.h", "```:`"])


NASTY = [
    "", "<", "<|", "<\\|", "<\\\\|im_end|>", "<|im_end|>", "<|im_start|>assistant\nok<|im_end|>\n", "a<", "\n\n", "~0~1\\n", "é😀<|im_end|>", "<\\", "\\|x",
]


def brute(rows):
    out = {}
    for conv in {r[0] for r in rows}:
        turns = sorted(((r[1] is not None, r[1] or 0), r[2] or "", r[3] or "") for r in rows if r[0] == conv)
        loss = "".join(t for _, role, t in turns if role == "assistant")
        out[conv] = (len(turns), digest("".join(f"{a}\n{b}\n" for _, a, b in turns)), len(loss), digest(loss))
    return out


def test_chat_round_trip(spark):
    rows = [(k, i, ["user", "assistant", "a~\nb<|im_end|>", None][(k + i) % 4], text) for k in range(4) for i, text in enumerate(NASTY)]
    rows += [(9, 0, "user", None), (9, None, "assistant", "first"), (9, 0, "user", None), (None, 1, "assistant", "x"), (None, 1, "assistant", "x")]
    rows += [(10, i, "assistant" if i % 2 else "user", f"<|{i}") for i in range(700)] + [(11, 0, "assistant", "<|x " * 50_000)]
    df = spark.createDataFrame([(*r, 5, "f") for r in rows], ROWS)
    done = chat.formatted(chat.canonical_turns(chat.records_of_rows(df))).cache()
    got = {r.conv_id: r for r in chat.chat_digests(done).collect()}
    want = brute(rows)
    assert {k: (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) for k, r in got.items()} == want
    for r in done.collect():
        assert r.layout == "turns" and r.formatted.count("<|im_start|>") == r.formatted.count("<|im_end|>") == len(r.turns)
        assert got[r.conv_id].formatted_chars == len(r.formatted)
        kept = [re.sub(r"<\\(\\*)\|", r"<\1|", r.formatted[m.start : m.stop]) for m in r.loss_mask if m.loss]
        assert kept == [t.text for t in r.turns if t.role == "assistant"]
    assert chat.chat_digests(chat.formatted(chat.canonical_turns(chat.records_of_rows(df.limit(0))))).count() == 0


def test_block_tree():
    rng = np.random.default_rng(1)
    for n in (0, 1, 2, 7, 64, 100):
        counts = rng.integers(0, 4, n)
        tree = fill_middle.BlockTree(counts)
        assert [tree.total(i) for i in range(n + 1)] == [counts[:i].sum() for i in range(n + 1)]
        owners = np.repeat(np.arange(n), counts)
        inside = np.concatenate([np.arange(1, c + 1) for c in counts]) if n else []
        assert [tree.descend(k) for k in range(1, counts.sum() + 1)] == list(zip(owners, inside))


@pytest.mark.parametrize("unit", [None, r"[^\x20\x0a]+[\x20\x0a]*", r"[^\x0a]*\x0a"])
def test_cuts_of_units(unit, monkeypatch):
    monkeypatch.setattr(fill_middle, "BLOCK", 5)
    for text in ("", "a", "é", "  two é😀 wörds\nand  lines\n\nend", "x" * 23, "😀" * 9 + "\n"):
        data = text.encode()
        ends = [i + 1 for i in range(len(text))] if unit is None else [m.end() for m in re.finditer(unit, text) if m.group()]
        body = fill_middle.BlockText(data, re.compile(unit.encode()) if unit else None)
        assert body.n == len(ends) and body.n_chars == len(text)
        for k, chars in enumerate([0, *ends]):
            assert body.cut(k) == (len(text[:chars].encode()), chars)


def plain_fill(doc_id, text):
    text = text or ""
    h = digest(f"1:{'' if doc_id is None else doc_id}")
    h1, h2, h3, h4 = (int(h[i : i + 8], 16) for i in (0, 8, 16, 24))
    n = len(text)
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h3 % 100 >= 90:
        return (n, "plain", None, None, text)
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    if h4 % 100 < 20:
        return (n, "spm", a, b - a, f"<S>{text[b:]}<P>{text[:a]}<M>{text[a:b]}")
    return (n, "psm", a, b - a, f"<P>{text[:a]}<S>{text[b:]}<M>{text[a:b]}")


def test_fill_in_middle(made):
    rows = [(i, "wörd <S 😀\x00 P> " * (i % 7)) for i in range(150)] + [(None, None), (None, "abc"), (500, ""), (501, "x<P>y"), (502, "é😀" * 60_000), (502, "é😀" * 60_000)]
    out = fill_middle.fill_in_middle(made(rows)).withColumn("whole", fill_middle.restored(F.col("output"), F.col("form"))).collect()
    got = Counter((r.doc_id, r.n, r.form, r.prefix_chars, r.middle_chars, r.output, r.whole) for r in out)
    assert got == Counter((i, *plain_fill(i, t), t or "") for i, t in rows)
    assert {k[2] for k in got} == {"plain", "psm", "spm"}
    assert fill_middle.fill_digests(made([]).limit(0)).count() == 0
    lines = fill_middle.fill_in_middle(made([(i, "a\nbb\nccc") for i in range(40)]), unit=r"[^\x0a]*\x0a").filter("form <> 'plain'").collect()
    assert lines and {r.prefix_chars for r in lines} <= {0, 2, 5} and {r.n for r in lines} == {2}


def grams(text):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)
    return words, [" ".join(words[i : i + n]) for n in (1, 2, 3) for i in range(len(words) - n + 1)]


def plain_ranks(docs, bench):
    bucket = lambda g: zlib.crc32(g.encode()) % 10000
    s, t = Counter(), Counter()
    for _, text in docs:
        s.update(map(bucket, grams(text)[1]))
    for text in bench:
        t.update(map(bucket, grams(text)[1]))
    all_s, all_t = sum(s.values()), sum(t.values())
    out = []
    for i, text in docs:
        words, runs = grams(text)
        weight = sum(math.floor(1000 * math.log((t[b] + 1) * (all_s + 10000) / ((s[b] + 1) * (all_t + 10000)))) for b in map(bucket, runs))
        h = int(digest(f"42:{'' if i is None else i}")[:8], 16)
        out.append([i, len(runs), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None, len(words)])
    able = sorted((r for r in out if r[5] >= 20), key=lambda r: (-r[3], r[0] is not None, r[0] or 0))
    for k, r in enumerate(able[: 5 * len(able) // 100]):
        r[4] = k + 1
    return Counter(tuple(r[:5]) for r in out)


def test_importance_ranks(docs, spark, made):
    bench = spark.read.parquet(f"{SF}/benchmark.parquet")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    rows += [(9001, None), (9002, ""), (9003, "ÀB a.a_a a"), (9004, "x" * 70_000 + " ÄÖ y"), (9005, "A b-C " * 40_000), (None, "w " * 30), (9006, "the " * 25), (9006, "the " * 25)]
    got = resample.importance_ranks(made(rows), bench).collect()
    want = plain_ranks(rows, [r.text for r in bench.collect()])
    assert Counter(tuple(r) for r in got) == want and any(k[4] for k in want)
    picked = resample.resampled(docs, bench).collect()
    assert len(picked) == 5 * docs.filter(F.size(F.split("text", " ")) >= 20).count() // 100 and {"text", "rank"} <= set(picked[0].asDict())


def test_importance_without_rows(made, spark):
    bench = spark.read.parquet(f"{SF}/benchmark.parquet")
    assert resample.importance_ranks(made([]).limit(0), bench).count() == 0
    few = resample.importance_ranks(made([(1, "a b " * 20)]), bench.limit(0)).collect()
    assert [tuple(r) for r in few] == list(plain_ranks([(1, "a b " * 20)], []))


def test_blocks_carry_words(monkeypatch):
    texts = [t.encode() for t in ("a b c d e f", "", "a", "b c", "ü" * 40, "x y z x y z", "...")]
    def all_runs():
        return Counter((int(o), int(b)) for _, owner, bucket in resample.features(texts) for o, b in zip(owner, bucket))
    whole = all_runs()
    monkeypatch.setattr(resample, "BLOCK", 1)
    assert all_runs() == whole == Counter((i, zlib.crc32(g.encode()) % 10000) for i, t in enumerate(texts) for g in grams(t.decode())[1])

import random

from tidemark.llm import chat


def brute(turns, pairs):
    talks = {}
    for c, t, r, x in turns:
        if c is not None and t is not None:
            key = (r or "user", x or "")
            talks.setdefault(c, {})
            talks[c][t] = min(talks[c].get(t, key), key)
    talks = {c: [v for _, v in sorted(d.items())] for c, d in talks.items()}
    out = {}
    show = lambda t: f"<|{t[0]}|>\n{t[1]}<|end|>\n"
    for p, a, b in pairs:
        x, y = talks.get(a), talks.get(b)
        n = 0
        while x and y and n < min(len(x), len(y)) and x[n] == y[n]:
            n += 1
        side = []
        for t in (x, y):
            if t is None:
                side += [None, None]
                continue
            text, mask = "", []
            for turn in t[n:]:
                piece = show(turn)
                if turn[0] == "assistant":
                    mask.append((len(text) + len(piece) - len(turn[1]) - 8, len(text) + len(piece) - 1))
                text += piece
            side += [text, mask]
        out[p] = (n, "".join(map(show, (x or y or [])[:n])), *side, side[0] is not None and side[2] is not None and side[0] != side[2])
    return out


def test_against_plain_formatting(spark):
    random.seed(1)
    turns = []
    for c in range(40):
        for t in range(random.randint(1, 5)):
            turns.append((c, t, random.choice(["user", "assistant", "system", None]), random.choice(["hi", "yes", "", None, "no\n"])))
            if random.random() < 0.2:
                turns.append((c, t, "user", "again"))
    turns += [(50, 0, "user", "q"), (50, 1, "assistant", "é" * 5000), (51, 0, "user", "q"), (51, 1, "assistant", "B"), (52, 0, "user", "q"), (53, 0, "user", "q"), (None, 1, "user", "x"), (7, None, "user", "x")]
    pairs = [(k, random.randint(0, 39), random.randint(0, 39)) for k in range(60)] + [(100, 50, 51), (101, 52, 53), (102, 50, 999), (103, 998, 999), (104, 50, 50)]
    df = spark.createDataFrame([(*t, "z") for t in turns], "conv_id long, turn long, role string, text string, prompt string")
    got = chat.preference_pairs(df, spark.createDataFrame(pairs, "pair_id long, chosen_id long, rejected_id long")).collect()
    want = brute(turns, pairs)
    spans = lambda m: None if m is None else [(s.start, s.end) for s in m]
    assert len(got) == len(pairs)
    for r in got:
        assert (r.n_prompt_turns, r.prompt, r.chosen, spans(r.chosen_mask), r.rejected, spans(r.rejected_mask), r.is_preference) == want[r.pair_id]
        for text, mask in ((r.chosen, r.chosen_mask), (r.rejected, r.rejected_mask)):
            for s in mask or []:
                assert text[s.start : s.end].endswith("<|end|>") and "<|assistant|>\n" == text[s.start - 14 : s.start]


def test_empty(spark):
    turns = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert chat.preference_pairs(turns, spark.createDataFrame([], "pair_id long, chosen_id long, rejected_id long")).count() == 0

import random
import re

from tidemark.llm import quality as Q


def base(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    grams = {}
    for k in range(len(words) - 7):
        grams.setdefault(tuple(words[k : k + 8]), []).append(k)
    covered = {k + j for v in grams.values() if len(v) > 1 for k in v for j in range(8)}
    seen, dup = set(), 0
    for line in text.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in seen
            seen.add(line)
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(covered)


def texts():
    random.seed(7)
    word = lambda: random.choice(["the", "of", "é", "日本", "a#b", "<x>", "y", "z", "\x1c", "q\x85q", " "])
    out = [None, "", " \n\t\x0b\x0c\r ", "a\n\na\na ", "one"]
    out += ["".join(word() + random.choice([" ", "\n", "  ", "\t", "\r\n"]) for _ in range(random.randint(0, 120))) for _ in range(150)]
    return [*out, "a b c d e f g h " * 30, "x y " * 40]


def test_base_measures(spark, monkeypatch):
    rows = list(enumerate(texts()))
    df = spark.createDataFrame([(i, t, "h") for i, t in rows], "doc_id long, text string, source string")
    got = {r.doc_id: r for r in Q.line_frequency_filter(df).collect()}
    for i, t in rows:
        r, (n, *rest) = got[i], base(t)
        assert [r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words] == [n, *rest], repr(t)
        assert r.base_failed == (n < 20 or 100 * rest[-1] > 30 * n)
    monkeypatch.setattr(Q, "LONG", 0)
    for _, t in rows:
        w = (t or "").encode().split()
        assert Q.repeat_words(w) == base(t)[-1]


def test_lines_of_many_documents_of_a_host(spark):
    own = lambda i, k: " ".join(f"own{i}x{k}w{j}" for j in range(12))
    shared = "Subscribe to   our newsletter for daily updates and more offers today"
    rows = [(i, "a", "\n".join([own(i, 0), own(i, 1), own(i, 2), shared.upper() if i % 2 else shared])) for i in range(30)]
    rows += [(100 + i, "a", "\n".join([shared] * 3 + [own(i, 5)])) for i in range(5)]
    rows += [(200 + i, "b", "\n".join([shared, own(i, 1), own(i, 2)])) for i in range(10)] + [(300 + i, None, own(i, 3) + "\n" + own(i, 4)) for i in range(4)] + [(300, None, own(0, 3) + "\n" + own(0, 4))]
    df = spark.createDataFrame([(i, t, h, 1) for i, h, t in rows], "doc_id long, text string, source string, n_words int")
    got = {r.doc_id: r for r in Q.line_frequency_filter(df, max_docs=20, max_share=0.5).collect()}
    size = len(shared.split())
    assert all(got[i].n_removed_words == size and got[i].kept for i in range(30))
    assert all(got[100 + i].n_removed_words == 3 * size and got[100 + i].depleted and not got[100 + i].kept for i in range(5))
    assert all(got[200 + i].n_removed_words == 0 and got[200 + i].kept for i in range(10))
    assert all(got[300 + i].kept for i in range(4))
    assert Q.line_frequency_filter(df.limit(0)).count() == 0

import random

from hypothesis import given, settings
from hypothesis import strategies as st

from tidewater.llm import decontaminate, registry

WORDS = [f"w{i}" for i in range(400)]


def edit(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def least_ends(pattern, words):
    """The least distance of the pattern to a stretch that ends with each word."""
    rows = [0] * (len(words) + 1)
    column = list(range(len(pattern) + 1))
    out = []
    for w in words:
        new = [0]
        for i, p in enumerate(pattern, 1):
            new.append(min(column[i] + 1, new[i - 1] + 1, column[i - 1] + (p != w)))
        column = new
        out.append(column[-1])
    return out


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from("abc"), min_size=1, max_size=12), st.lists(st.sampled_from("abc"), max_size=30))
def test_myers_is_the_plain_distance(pattern, words):
    own = decontaminate.Pattern(pattern, 2)
    assert list(own.distances(words, own.forward, False)) == least_ends(pattern, words)
    for distance, a, b in own.matches(words):
        assert edit(pattern, words[a:b]) == distance <= 2


def changed(words, edits):
    words = list(words)
    for _ in range(edits):
        at = random.randrange(len(words))
        kind = random.randrange(3)
        if kind == 0:
            words[at] = random.choice(WORDS)
        elif kind == 1:
            words.insert(at, random.choice(WORDS))
        else:
            del words[at]
    return words


def test_every_match_within_the_budget_is_found():
    random.seed(1)
    items = [(k, " ".join(random.choices(WORDS, k=random.randint(5, 60)))) for k in range(60)]
    matcher = decontaminate.Matcher(items)
    for k, text in items:
        words = text.split()
        for edits in (0, 1, len(words) // 5):
            document = random.choices(WORDS, k=50) + changed(words, edits) + random.choices(WORDS, k=50)
            want = {i for i, t in items if min(least_ends(t.split(), document)) <= int(len(t.split()) * 0.2 + 1e-9)}
            assert {m[0] for m in matcher.find(" ".join(document))} == want
            assert k in want


def test_places_and_forms():
    matcher = decontaminate.Matcher([(1, "The quick, brown fox jumps over the lazy dog today"), (2, "one two"), (3, None), (4, "...")])
    text = "İx THE QUICK brown-fox\njumps over THE lazy cat today! and one. TWO one two"
    found = matcher.find(text)
    assert [(i, d, text[a:b]) for i, d, _, a, b in found if i == 1] == [(1, 1, "THE QUICK brown-fox\njumps over THE lazy cat today")]
    assert [text[a:b] for i, _, _, a, b in found if i == 2] == ["one. TWO", "one two"]
    assert matcher.find(None) == matcher.find("") == [] and decontaminate.Matcher([]).find("x") == []


def test_query_against_the_plain_distance(spark, small):
    items = {r.item_id: r.text for r in spark.read.parquet(f"{small}/benchmark.parquet").collect()}
    words = {i: decontaminate._WORD.findall(t.lower()) for i, t in items.items()}
    pieces = {}
    for i, w in words.items():
        pieces.setdefault(w[0], set()).add(i)
    want = set()
    docs = spark.read.parquet(f"{small}/documents.parquet").collect()
    known = {i: set(w) for i, w in words.items()}
    for d in docs:
        own = decontaminate._WORD.findall((d.text or "").lower())
        there = set(own)
        for i, w in words.items():
            budget = len(w) // 5
            if len(known[i] - there) <= budget and min(least_ends(w, own), default=9**9) <= budget:
                want.add((d.doc_id, i))
    got = {(r.doc_id, r.item_id) for r in registry.op7_decontamination(spark, small).collect()}
    assert got == want and want


def test_blocks_give_the_same(spark, small):
    docs, bench = (spark.read.parquet(f"{small}/{t}.parquet") for t in ("documents", "benchmark"))
    whole = sorted(tuple(r) for r in decontaminate.find_items(docs, bench).collect())
    assert sorted(tuple(r) for r in decontaminate.find_items(docs, bench, block_bytes=4000).collect()) == whole


def test_edges(spark, edges, none):
    bench = spark.createDataFrame([(1, "a second line that has some more words"), (2, None), (3, "")], "item_id bigint, text string")
    got = decontaminate.find_items(edges, bench).collect()
    assert sorted(map(repr, (r.doc_id for r in got))) == ["1", "2", "2", "None"]
    clean = decontaminate.decontaminate(edges, bench)
    assert clean.columns == edges.columns and sorted(map(repr, (r.doc_id for r in clean.collect()))) == ["3", "4", "5", "6", "7", "7", "8", "None"]
    assert decontaminate.find_items(none, bench).count() == 0
    assert decontaminate.find_items(edges, bench.where("item_id > 9")).count() == 0
    assert decontaminate.decontaminate(edges, bench.where("item_id > 9")).count() == edges.count()


def test_only_rows_that_hold_an_item_go(spark):
    bench = spark.createDataFrame([(1, "a second line that has some more words"), (2, "one more item of six words")], "item_id bigint, text string")
    rows = [(None, "clean"), (None, "with a second line that has some more words in it"), (None, None), (1, "clean too"), (1, "one more item of six words"), (2, "")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    for size in (decontaminate.BLOCK_BYTES, 30):
        got = [tuple(r) for r in decontaminate.decontaminate(docs, bench, block_bytes=size).collect()]
        assert sorted(map(repr, got)) == sorted(map(repr, [rows[0], rows[2], rows[3], rows[5]]))


def test_scripts_without_spaces():
    matcher = decontaminate.Matcher([(1, "天気はとても良いです"), (2, "อากาศดีมาก")])
    text = "今日の天気はとても良いですね。"
    assert [(i, d, text[a:b]) for i, d, _, a, b in matcher.find(text)] == [(1, 0, "天気はとても良いです")]
    assert [m[:2] for m in matcher.find("今日の天気はとても悪いです")] == [(1, 1)]
    assert [m[0] for m in matcher.find("วันนี้อากาศดีมากครับ")] == [2]


def test_long_texts():
    random.seed(5)
    items = [(k, " ".join(random.choices(WORDS, k=30))) for k in range(5)]
    document = random.choices(WORDS, k=20_000)
    for at, (_, text) in zip((0, 9_000, 19_970), items):
        document[at : at + 30] = changed(text.split(), 3)
    want = {i for i, t in items if min(least_ends(t.split(), document)) <= 6}
    assert {m[0] for m in decontaminate.Matcher(items).find(" ".join(document))} == want and {0, 1, 2} <= want

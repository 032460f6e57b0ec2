import random

from tidewater.llm import registry, substring_dedup

random.seed(5)
WORDS = ["".join(random.choice(["an", "the", "or", "é", "sh", "tion", "ing", "ou"]) for _ in range(random.randint(1, 4))) for _ in range(4000)]


def prose(n):
    return " ".join(random.choice(WORDS) for _ in range(n))


def docs(spark, rows):
    return spark.createDataFrame(rows, "doc_id bigint, text string")


def covered(rows, doc):
    return sum(r.end - r.start for r in rows if r.doc_id == doc)


def gear(data):
    """Where a chunk may end, by the rolling form of the hash."""
    h, out = 0, []
    for i, b in enumerate(data):
        h = ((h << 1) + int(substring_dedup._GEAR[b])) & 0xFFFF
        if h >> (16 - substring_dedup.BITS) == 0 and not (i + 1 < len(data) and data[i + 1] & 0xC0 == 0x80):
            out.append(i + 1)
    return out


def test_chunks_follow_the_rolling_hash():
    for n in (0, 1, 5, 300):
        data = prose(n).encode()
        ends, marks = substring_dedup.ends(data), set(gear(data))
        assert (ends[-1] if ends else 0) == len(data)
        for a, b in zip([0, *ends], ends):
            assert b - a <= substring_dedup.MOST and (b - a >= substring_dedup.LEAST or b == len(data))
            assert b in marks or b == len(data) or b - a > substring_dedup.MOST - 4
            data[a:b].decode()  # between characters


def test_insertions_move_few_chunks():
    text = prose(2000).encode()
    cut = lambda d: {d[a:b] for a, b in zip([0, *substring_dedup.ends(d)], substring_dedup.ends(d))}
    before = cut(text)
    assert len(before - cut(text[:5000] + b"inserted" + text[5000:])) <= 8


def test_planted_passages_are_caught_and_clean_documents_left_alone(spark):
    passages = [prose(60) for _ in range(40)]
    rows = [(i, prose(300)) for i in range(100)]
    for k, p in enumerate(passages):
        for at in (k, 99 - k):
            words = rows[at][1].split(" ")
            place = random.randint(0, len(words))
            rows[at] = (at, " ".join([*words[:place], p, *words[place:]]))
    found = substring_dedup.repeats(docs(spark, rows)).collect()
    assert {r.doc_id for r in found} == {99 - k for k in range(40)}
    assert all(r.first_ids == [99 - r.doc_id] for r in found)
    for k, p in enumerate(passages):
        assert covered(found, 99 - k) >= len(p.encode())


def plain(rows, least):
    """First holders in a dict; stretches by a loop over chunks; extension by comparing whole texts."""
    first, out = {}, []
    data = {i: t.encode() for i, t in rows if t}
    pieces = {i: [(a, b, d[a:b]) for e in [substring_dedup.ends(d)] for a, b in zip([0, *e], e)] for i, d in data.items()}
    for i in sorted(pieces):
        for a, _, c in pieces[i]:
            first.setdefault(c, (i, a))
    for i, own in pieces.items():
        stretches = []
        for a, b, c in own:
            f, at = first[c]
            if f == i:
                continue
            if stretches and stretches[-1][1] == a and stretches[-1][2] == f and stretches[-1][3] + a - stretches[-1][0] == at:
                stretches[-1][1] = b
            else:
                stretches.append([a, b, f, at])
        covered = {}
        for a, b, f, at in stretches:
            if b - a >= substring_dedup.CANDIDATE:
                theirs, shift, low, high = data[f], at - a, a - substring_dedup.CONTEXT, b + substring_dedup.CONTEXT
                while a > max(0, low) and a + shift > 0 and data[i][a - 1] == theirs[a + shift - 1]:
                    a -= 1
                while b < min(len(data[i]), high) and b + shift < len(theirs) and data[i][b] == theirs[b + shift]:
                    b += 1
            while 128 <= data[i][a] < 192:
                a += 1
            while b < len(data[i]) and 128 <= data[i][b] < 192:
                b -= 1
            for x in range(a, b):
                covered.setdefault(x, set()).add(f)
        places = sorted(covered)
        while places:
            n = 1
            while n < len(places) and places[n] == places[0] + n:
                n += 1
            if n >= least:
                out.append((i, places[0], places[0] + n, sorted(set().union(*(covered[x] for x in places[:n])))))
            places = places[n:]
    return sorted(out)


def test_query_against_a_plain_computation(spark, small):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{small}/documents.parquet").collect()]
    want = plain(rows, substring_dedup.RUN)
    assert sorted(tuple(r) for r in registry.op4_substring_dedup(spark, small).collect()) == want and want


def test_short_passages_of_many_places_are_caught(spark):
    """Passages of 51 words, each in two documents between other words."""
    rows, found = [(i, prose(200)) for i in range(400)], {}
    for k in range(200):
        p = prose(51)
        for at in (k, k + 200):
            words = rows[at][1].split(" ")
            rows[at] = (at, " ".join([*words[:100], p, *words[100:]]))
        found[k + 200] = len(p.encode())
    got = substring_dedup.repeats(docs(spark, rows)).collect()
    assert {r.doc_id for r in got} <= set(found) and len({r.doc_id for r in got}) >= 0.98 * len(found)


def test_rows_without_an_id(spark):
    passage = prose(80)
    rows = [(1, f"{prose(50)} {passage} {prose(50)}"), *((None, f"{prose(30 + k)} {passage} {prose(20)}") for k in range(5))]
    got = substring_dedup.repeats(docs(spark, rows)).collect()
    texts = [t.encode() for i, t in rows if i is None]
    assert len(got) == 5 and all(r.doc_id is None and r.first_ids == [1] for r in got)
    assert all(any(passage.encode() in t[r.start : r.end] for t in texts) for r in got)
    left = [r.text for r in substring_dedup.cut(docs(spark, rows)).collect() if r.doc_id is None]
    assert len(left) == 5 and not any(passage in t for t in left)


def test_cut(spark, edges, none):
    got = substring_dedup.cut(edges, 32)
    assert got.columns == edges.columns
    rows = got.collect()
    assert len(rows) == edges.count()
    whole = edges.where("doc_id = 1").first().text
    assert [r.text for r in rows if r.doc_id == 1] == [whole]
    assert all(len(r.text) < len(whole) for r in rows if r.doc_id == 2)
    assert sorted(r.text for r in rows if r.doc_id == 7) == ["one", "two of one id"]
    assert substring_dedup.cut(none).count() == 0 and substring_dedup.repeats(none).count() == 0

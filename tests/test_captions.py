import random
import re

from tidemark.operators import captions as C


def plain(words, size, least, pause):
    groups, least = [], max(1, min(least, size))
    for n, (text, a, b) in enumerate(words):
        if groups and not (a - words[n - 1][2] > pause or len(groups[-1]) >= size or re.search(C.ENDED, words[n - 1][0])):
            groups[-1].append(n)
        else:
            groups.append([n])
    if len(groups) > 1 and len(groups[-1]) < least:
        both = groups[-2] + groups[-1]
        if len(both) < 2 * least:
            groups[-2:] = [both]
        else:
            cut = len(both) - min(least, len(groups[-1]) + max(len(groups[-2]) - least, 0))
            groups[-2:] = [both[:cut], both[cut:]]
    return groups


def plain_lines(words, groups, least_s):
    out = {}
    for g in groups:
        edges = []
        for e in [round(words[n][1] * 100) for n in g] + [round(words[g[-1]][2] * 100)]:
            edges.append(max([e, *edges[-1:]]))
        for n, a, b in zip(g, edges, edges[1:]):
            out[n] = (a, b) if b - a >= round(least_s * 100) else (None, None)
    return out


def test_captions_and_their_lines(spark):
    rnd, data = random.Random(1), {}
    for k in range(60):
        t, words = 0.0, []
        for _ in range(rnd.randrange(1, 16)):
            t += rnd.choice([0, 0, 0.05, 0.3, 1.3])
            words.append((rnd.choice(["a", "b", "end.", 'said."', "no,", "so?)"]), round(t, 3), round(t + rnd.choice([0.0, 0.11, 0.4]), 3)))
        data[k] = words
    rows = [(k, n, *w) for k, ws in data.items() for n, w in enumerate(ws)]
    df = spark.createDataFrame(rows, "k long, n long, w string, a double, b double").repartition(3)
    for size, least in ((4, 3), (5, 2), (1, 3), (3, 3)):
        got = {(r.k, r.n): (r.place, r.from_cs, r.to_cs) for r in C.caption_lines(C.caption_groups(df, ["k"], "n", "w", "a", "b", size, least), ["k"], "n", "a", "b", 0.1).collect()}
        for k, ws in data.items():
            groups = plain(ws, size, least, 1.2)
            lines = plain_lines(ws, groups, 0.1)
            assert {n: got[k, n] for n in range(len(ws))} == {n: (p, *lines[n]) for p, g in enumerate(groups) for n in g}, (k, size, least)

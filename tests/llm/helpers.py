"""Small tables and brute-force versions for the text operators."""

import re

BLANK = re.compile(r"[^\x20\x09-\x0D]+")


def words(text):
    return BLANK.findall(text or "")


def lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def shingles(text, size):
    found = words(lower(text))
    if not found:
        return frozenset()
    size = min(size, len(found))
    return frozenset(tuple(found[i:i + size])
                     for i in range(len(found) - size + 1))


def components(nodes, links):
    """node -> smallest node reached."""
    parent = {n: n for n in nodes}

    def find(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x
    for a, b in links:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def documents(spark, rows):
    return spark.createDataFrame(
        rows, "doc_id bigint, text string, lang string, source string")


def prose(rng, count, vocabulary=400):
    return " ".join(word(rng.randrange(vocabulary)) for _ in range(count))


def word(number):
    return "w" + "".join("abcdefghij"[int(d)] for d in str(number))

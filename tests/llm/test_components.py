import random

from tessera.llm.common import components


def brute(links):
    up = {}

    def root(x):
        up.setdefault(x, x)
        while up[x] != x:
            x = up[x]
        return x
    for a, b in links:
        if a != b:
            a, b = root(a), root(b)
            up[max(a, b)] = min(a, b)
    return {x: root(x) for x in up}


def test_components_against_brute_force(spark):
    r = random.Random(1)
    chain, star = [(i, i + 1) for i in range(-60, 0)], [(500, i) for i in range(501, 700)]
    some = [(r.randrange(1000, 1300), r.randrange(1000, 1300)) for _ in range(180)]
    links = chain + star + some + [(7, 7), star[0], star[0][::-1]]
    got = components(spark.createDataFrame(links, "a long, b long")).collect()
    assert {x.id: x.comp for x in got} == brute(links) and len(got) == len(brute(links))
    assert components(spark.createDataFrame([(7, 7)], "a long, b long")).count() == 0

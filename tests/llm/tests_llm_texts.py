"""Random texts for the near-duplicate tests."""

from __future__ import annotations


def text(rng, n=200):
    return "".join(rng.choice("abcdefghijklmnopqrstuvwxyz一二三四五六七八九十") for _ in range(n))


def edited(rng, t, share):
    out = list(t)
    for _ in range(int(len(t) * share)):
        i = rng.randrange(len(out))
        kind = rng.random()
        if kind < 0.5:
            out[i] = rng.choice("XYZ")
        elif kind < 0.75:
            out.insert(i, rng.choice("XYZ"))
        else:
            del out[i]
    return "".join(out)


def likeness(a, b):
    a, b = ("".join(x.split()) for x in (a, b))
    x, y = ({t[i : i + 5] for i in range(len(t) - 4)} for t in (a, b))
    return len(x & y) / len(x | y) if x and y else 0.0

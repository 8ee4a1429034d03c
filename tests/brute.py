"""Plain Python versions of the relationship rules, for comparison on small inputs."""

from collections import Counter


def split_list(value):
    if value == "":
        return [""]
    parts = value.split(",")
    while parts and parts[-1] == "":
        parts.pop()
    return parts


def overlap(left, right, as_sets=False):
    a, b = split_list(left), split_list(right)
    if not a or not b:
        return 0.0
    union = set(a) | set(b)
    shared = set(a) & set(b) if as_sets else list((Counter(a) & Counter(b)).elements())
    return len(shared) / len(union)


def edges(kb, targets, features, as_sets=False):
    """{(object, other, feature, weight rounded): newest ts} from (id, type, value, ts) rows."""
    found = {}
    for target in targets:
        for f in features:
            mine = [(ts, v) for o, t, v, ts in kb if o == target and t == f.name]
            if not mine:
                continue
            value = max(mine)[1]
            for other, t, v, ts in kb:
                if t != f.name or other == target:
                    continue
                if f.exact:
                    weight = f.weight if v == value else 0.0
                else:
                    weight = overlap(v, value, as_sets)
                if weight > 0:
                    key = (target, other, f.name, round(weight, 9))
                    found[key] = max(ts, found.get(key, ts))
    return found

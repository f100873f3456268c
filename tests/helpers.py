"""Random event logs and plain row-at-a-time models to compare with."""

import random
from collections import defaultdict

VERBS = ["get", "list", "watch", "create", "update", "patch", "delete"]
RESOURCES = ["secrets", "pods", "clusterrolebindings", "clusterroles", "roles", "deployments",
             "serviceaccounts", "selfsubjectaccessreviews", "certificatesigningrequests", "configmaps"]
SUBS = ["", "", "exec", "token"]
EVENT_SCHEMA = ("audit_id bigint, us bigint, session bigint, actor string, verb string, "
                "resource string, sub string, ns string, code int, decision string, imp string, "
                "is_imp int, source_ip string, k int, ts timestamp")


def random_events(n, seed, hot=0.5, step_us=4_000_000):
    """n events; one actor holds ``hot`` of them, and some times repeat."""
    import datetime as dt
    rng = random.Random(seed)
    rows, us = [], 1_700_000_000_000_000
    for i in range(n):
        us += rng.choice([0, 0, 1_000_000, step_us, rng.randrange(step_us * 4)])
        actor = "hot" if rng.random() < hot else f"a{rng.randrange(5)}"
        imp = rng.choice(["", "", "v1", "v2"])
        forbid = rng.random() < 0.2
        rows.append((i, us, rng.randrange(2), actor, rng.choice(VERBS), rng.choice(RESOURCES),
                     rng.choice(SUBS), rng.choice(["", "n1", "n2", "n3"]),
                     rng.choice([0, 200, 201, 403, 404, 500]), "forbid" if forbid else "allow",
                     imp, int(imp != ""), f"ip{rng.randrange(3)}", i % 10,
                     dt.datetime(1970, 1, 1, tzinfo=dt.timezone.utc) + dt.timedelta(microseconds=us)))
    rng.shuffle(rows)
    return rows


def names():
    return [f.split()[0] for f in EVENT_SCHEMA.split(", ")]


def as_dicts(rows):
    return [dict(zip(names(), r)) for r in rows]


RBAC = {"clusterroles", "clusterrolebindings", "roles", "rolebindings"}


def _signals(e):
    return {
        "secret": e["resource"] == "secrets" and e["verb"] in ("get", "list", "watch"),
        "rbw": e["resource"] in RBAC and e["verb"] in ("create", "update", "patch", "delete"),
        "crb": e["resource"] in ("clusterrolebindings", "clusterroles") and e["verb"] == "create",
        "exec": e["sub"] == "exec",
        "review": e["verb"] == "create" and e["resource"].startswith("selfsubject"),
        "csr": e["resource"] == "certificatesigningrequests",
        "tok": e["verb"] == "create" and e["resource"] == "serviceaccounts" and e["sub"] == "token",
        "wl": e["verb"] == "create" and e["resource"] in ("deployments", "pods"),
    }


def features_by_hand(rows, size=20):
    """audit_id -> feature dict, by slicing each actor's ordered list."""
    groups = defaultdict(list)
    for e in sorted(as_dicts(rows), key=lambda e: (e["us"], e["audit_id"])):
        groups[(e["session"], e["actor"])].append(e)
    out = {}
    for events in groups.values():
        sig = [_signals(e) for e in events]
        for i, e in enumerate(events):
            lo = max(0, i - size + 1)
            win, ws = events[lo:i + 1], sig[lo:i + 1]
            n = len(win)
            cnt = lambda f: sum(1 for x in win if f(x))
            any_ = lambda k: int(any(s[k] for s in ws))
            f = {
                "n_events": n, "n_forbid": cnt(lambda x: x["decision"] == "forbid"),
                "n_distinct_resource": len({x["resource"] for x in win}),
                "n_distinct_verb": len({x["verb"] for x in win}),
                "n_distinct_ns": len({x["ns"] for x in win}),
                "n_secrets": cnt(lambda x: x["resource"] == "secrets"),
                "n_exec": cnt(lambda x: x["sub"] == "exec"),
                "n_rbac": cnt(lambda x: x["resource"] in RBAC),
                "n_create": cnt(lambda x: x["verb"] == "create"),
                "n_delete": cnt(lambda x: x["verb"] == "delete"),
                "n_list": cnt(lambda x: x["verb"] == "list"),
                "n_4xx": cnt(lambda x: x["code"] >= 400),
                "n_selfreview": sum(s["review"] for s in ws),
                "n_create_workload": sum(s["wl"] for s in ws),
                "secret_ns": len({x["ns"] for x, s in zip(win, ws) if s["secret"]}),
                "n_distinct_impersonated": len({x["imp"] for x in win if x["is_imp"]}),
                "has_secret": any_("secret"), "has_exec": any_("exec"),
                "has_rbac_write": any_("rbw"), "has_crb": any_("crb"), "has_csr": any_("csr"),
                "has_tokenreq": any_("tok"),
                "has_impersonation": int(any(x["is_imp"] for x in win)),
                "cum_secrets": sum(s["secret"] for s in sig[:i + 1]),
                "cum_rbac_w": sum(s["rbw"] for s in sig[:i + 1]),
                "cum_exec": sum(s["exec"] for s in sig[:i + 1]),
                "cum_crb": sum(s["crb"] for s in sig[:i + 1]),
            }
            f["has_forbid"] = int(f["n_forbid"] > 0)
            f["forbid_ratio"] = round(f["n_forbid"] / n, 3)
            f["secret_rate"] = round(f["n_secrets"] / n, 3)
            f["rbac_rate"] = round(f["n_rbac"] / n, 3)
            f["create_rate"] = round(f["n_create"] / n, 3)
            f["selfreview_ratio"] = round(f["n_selfreview"] / n, 3) if n >= size else 0.0
            f["severity"] = (3 * f["has_crb"] + 2 * f["has_exec"] + 2 * (f["secret_ns"] >= 2)
                             + f["has_rbac_write"] + 2 * f["has_impersonation"])
            out[e["audit_id"]] = f
    return out


def times_by_hand(rows):
    groups = defaultdict(list)
    for e in sorted(as_dicts(rows), key=lambda e: (e["us"], e["audit_id"])):
        groups[e["actor"]].append(e)
    out = {}
    for events in groups.values():
        for i, e in enumerate(events):
            win = [x for x in events[:i + 1] if x["us"] >= e["us"] - 60_000_000]
            out[e["audit_id"]] = (
                sum(1 for x in win if x["us"] >= e["us"] - 5_000_000), len(win),
                len({x["resource"] for x in win}), len({x["verb"] for x in win}),
                sum(1 for x in win if str(x["code"])[0] in "45"),
                sum(1 for x in win if x["verb"] in ("get", "list", "watch")) / len(win),
                (e["us"] - events[i - 1]["us"]) / 1e6 if i else -1.0)
    return out


def incidents_by_hand(alerts, gap_us):
    """alerts: (seq, us, actor, hint) -> [(actor, start, [hints in order])]."""
    by = defaultdict(list)
    for a in sorted(alerts, key=lambda a: (a[1], a[0])):
        by[a[2]].append(a)
    out = []
    for actor, items in by.items():
        run = [items[0]]
        for a in items[1:]:
            if a[1] - run[-1][1] <= gap_us:
                run.append(a)
            else:
                out.append((actor, run[0][1], [x[3] for x in run if x[3]]))
                run = [a]
        out.append((actor, run[0][1], [x[3] for x in run if x[3]]))
    return out


def strongest_chain(hints, chains):
    best = None
    for name, seq, boost in chains:
        it = iter(hints)
        if all(any(h == t for h in it) for t in seq) and (best is None or boost > best[1]):
            best = (name, boost)
    return best[0] if best else None

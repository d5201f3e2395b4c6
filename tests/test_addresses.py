"""IPv6 addresses of every valid form are addresses: no network admits them by default."""

import ipaddress
import random
import string

from presence.functions import text
from presence.operators.gates import ip_allowlist


def test_mapped_and_zoned_addresses_do_not_skip_the_check(spark):
    deny = ["::ffff:8.8.8.8", "fe80::1%eth0", "64:ff9b::8.8.8.8", "1:2:3:4:5:6:8.8.8.8", "2001:db8::1", "8.8.8.8"]
    deny += ["fe80::1%ens3", "fe80::1%wlp2s0", "2001:db8::1%s"] + [f"fe80::1%{c}" for c in string.printable if c != "%"]
    none = ["unknown", "::ffff:8.8.8", "fe80::1%", "0:0:1", "1:2:3:4:5::1:2:3:1.2.3.4", "1:2:3:4:5:6:7::8:9", "::1\n", "fe80::1%a%b"]
    rows = spark.createDataFrame([(x,) for x in deny + none], "client_ip string")
    got = {r.client_ip: r.admitted for r in ip_allowlist(rows).collect()}
    assert [x for x in deny if got[x]] == [] and [x for x in none if not got[x]] == []
    loop = rows.select("client_ip", text.is_loopback(rows.client_ip).alias("l")).where("l").collect()
    assert loop == []


def test_grammar_agrees_with_a_parser(spark):
    r = random.Random(8)
    made = set()
    for _ in range(20_000):
        x = ":".join(r.choice(["0", "1", "abcd", "FF", "12345", "g", ""]) if r.random() < 0.2 else r.choice(["0", "a1"]) for _ in range(r.randint(0, 9)))
        if r.random() < 0.6:
            at = r.randint(0, len(x))
            x = x[:at] + r.choice([":", "::"]) + x[at:]
        if r.random() < 0.3:
            x += ":" * (r.random() < 0.7) + r.choice(["1.2.3.4", "256.1.1.1", "1.2.3", "01.2.3.4"])
        if r.random() < 0.2:
            x += "%" + r.choice(["eth0", "ens3", "s", " x", "a%b", "", "wlp2s0"])
        made.add(x)

    def known(x):
        try:
            return bool(ipaddress.ip_address(x))
        except ValueError:
            return False

    rows = spark.createDataFrame([(x,) for x in sorted(made)], "a string")
    got = {q.a: q.ok for q in rows.select("a", text.is_ip(rows.a).alias("ok")).collect()}
    assert [x for x in made if got[x] != known(x)] == []
    assert sum(got.values()) > 1000

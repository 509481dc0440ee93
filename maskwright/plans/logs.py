"""Log lines derived from ``orders``, with a value of each category at a known place.

The statement reads alike in Spark SQL and in DuckDB, so what a query should find
is known by arithmetic and not by a pattern.
"""

K, C = "o_orderkey", "o_custkey"
BS, NL = "chr(92)", "chr(10)"
# (category, alias prefix, folded key, text before, value, text after)
KINDS = [
    ("email", "EMAIL", True, "'user '", f"(case when {K} % 34 = 0 then 'USER' else 'user' end) || {C} || '@example.com'", "' logged in'"),
    ("ipv4", "IP", False, "'from '", f"'10.' || ({C} % 256) || '.' || ({K} % 256) || '.7'", "' ok'"),
    ("mac", "MAC", True, "'mac '", f"'de:ad:be:ef:' || printf('%02x', {C} % 256) || ':11'", "' up'"),
    ("url", "URL", False, "'see '", f"'https://host' || {C} || '.corp/x?ip=1.2.3.4'", "' ok'"),
    ("jwt", "JWT", False, "'jwt '", f"'eyJhbGci' || {C} || '.eyJzdWIi' || {K} || '.c2lnbmF0'", "' end'"),
    ("aws_key", "AWSKEY", False, "'key '", f"'AKIA' || lpad('' || {K}, 16, '0')", "' set'"),
    ("google_api_key", "GAPIKEY", False, "'key '", f"'AIza' || lpad('' || {C}, 35, '0')", "' set'"),
    ("bearer_token", "BEARER", False, "'Authorization: Bearer '", f"'tok' || lpad('' || {C}, 10, '0')", "' sent'"),
    ("windows_sid", "SID", False, "'sid '", f"'S-1-5-21-' || {K} || '-' || {C}", "' logon'"),
    ("uuid", "UUID", False, "'id '", f"'123e4567-e89b-12d3-a456-' || lpad('' || {C}, 12, '0')", "' done'"),
    ("ipv6", "IPV6", True, "'addr '", f"'2001:db8:0:0:0:0:' || printf('%x', {C} % 4096) || ':1'", "' up'"),
    ("windows_user_path", "WINUSER", False, f"'path C:' || {BS} || 'Users' || {BS}", f"'u' || {C}", f"{BS} || 'run.log done'"),
    ("fqdn", "HOST", True, "'peer '", f"(case when {K} % 26 = 0 then 'Host' else 'host' end) || {C} || '.corp.example.com'", "' up'"),
    ("credit_card", "CC", False, "'card '", "'4111 1111 1111 1111'", "' paid'"),
    ("private_key", "PRIVATE_KEY", False, "'pem '", f"'-----BEGIN RSA PRIVATE KEY-----' || {NL} || 'abc' || {C} || {NL} || '-----END RSA PRIVATE KEY-----'", "' done'"),
    ("phone", "PHONE", False, "'call '", f"'415-555-' || lpad('' || ({C} % 10000), 4, '0')", "' today'"),
    ("", "", False, "'firmware version '", f"'2.0.' || ({K} % 256) || '.0'", "' shipped'"),
]
N = len(KINDS)


def _case(at: int) -> str:
    return f"case {K} % {N} " + " ".join(f"when {i} then {k[at]}" for i, k in enumerate(KINDS)) + " end"


def _quoted(at: int) -> str:
    return f"case {K} % {N} " + " ".join(f"when {i} then '{k[at]}'" for i, k in enumerate(KINDS)) + " end"


FOLDED = ", ".join(f"'{k[0]}'" for k in KINDS if k[2])
LOGS = f"select id, cat, prefix, pre, val, pre || val || post txt from (select {K} id, {_quoted(0)} cat, {_quoted(1)} prefix, {_case(3)} pre, {_case(4)} val, {_case(5)} post from orders) q"
#: Occurrences, keys and aliases as they should be; phone is off by default.
CTES = f"""
with logs as ({LOGS}),
occ as (select id, cat, prefix, val, length(pre) s, case when cat in ({FOLDED}) then lower(val) else val end k from logs where cat not in ('', 'phone')),
keys as (select cat, prefix, k, min(id) first_id, count(*) cnt from occ group by cat, prefix, k),
al as (select *, '<' || prefix || '_' || row_number() over (partition by prefix order by first_id) || '>' alias, row_number() over (partition by prefix order by first_id) n from keys),
named as (select al.*, f.val original from al join occ f on f.id = al.first_id and f.cat = al.cat and f.k = al.k)
"""

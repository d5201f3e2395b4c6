"""String-valued inputs: payloads, model replies, headers, addresses."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Reply formats of the document-photo question.
LABEL_PATTERN = r"(?i)LABEL\s*[:=]?\s*(STUDIO_BACK\w*|REAL_BACKGROUND)"
CONFIDENCE_PATTERN = r"(?i)CONF[A-Z]*\s*[:=]\s*(\d{1,3})"
STUDIO_WORDS = ("STUDIO_BACKGROUND", "STUDIO_BACKDROP")
REAL_WORD = "REAL_BACKGROUND"

# Plain decimal or exponent notation, what a float parser takes minus nan/inf.
NUMBER_PATTERN = r"^\s*[+-]?(\d+(_\d+)*\.?(\d+(_\d+)*)?|\.\d+(_\d+)*)([eE][+-]?\d+(_\d+)*)?\s*$"
NOT_FINITE_PATTERN = r"(?i)^\s*[+-]?(nan|inf|infinity)\s*$"

_OCTET = r"(25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)"
IPV4_PATTERN = rf"^{_OCTET}(\.{_OCTET}){{3}}$"
_H = r"[0-9A-Fa-f]{1,4}"
_QUAD = rf"{_OCTET}(\.{_OCTET}){{3}}"
# "::" stands for at least one group, so at most seven are written (five
# beside a dotted quad, which is two): counted ahead, then the form.
IPV6_PATTERN = (
    rf"^((({_H}:){{7}}{_H}|({_H}:){{6}}{_QUAD})"
    rf"|(?=(:{{0,2}}[0-9A-Fa-f]+){{0,7}}(::)?(%|$))({_H}(:{_H})*)?::({_H}(:{_H})*)?"
    rf"|(?=(:{{0,2}}[0-9A-Fa-f]+(?!\.)){{0,5}}:{{1,2}}[0-9]+\.)({_H}(:{_H})*)?::({_H}:)*{_QUAD})(%[^%]+)?\z"
)


def decode_payload(encoded: Column) -> Column:
    """Base64 text to bytes; NULL where the text is not valid base64.

    Characters outside the alphabet are skipped, as lenient decoders do; the
    second attempt only runs for text the first one refuses.
    """
    cleaned = F.regexp_replace(encoded, r"[^A-Za-z0-9+/=]+", "")
    return F.coalesce(
        F.try_to_binary(encoded, F.lit("base64")), F.try_to_binary(cleaned, F.lit("base64"))
    )


def parse_document_replies(df: DataFrame, reply: str, prefix: str = "") -> DataFrame:
    """Read stored model replies: ran, is_document, confidence of "document".

    A labelled answer wins over bare keywords; a stated confidence refers to
    the stated label, so it is inverted for the real-background label; no
    number counts as 0.5; no label at all means the check did not run. Each
    pattern runs once per reply, keywords only where no label was found.
    """
    upper = F.when(F.col("_stated") == "", F.upper(reply))
    studio_word = F.lit(False)
    for word in STUDIO_WORDS:
        studio_word = studio_word | F.col("_upper").contains(word)
    is_document = (
        F.when(F.col("_stated").startswith("STUDIO_BACK"), F.lit(True))
        .when(F.col("_stated") == REAL_WORD, F.lit(False))
        .when(studio_word, F.lit(True))
        .when(F.col("_upper").contains(REAL_WORD), F.lit(False))
    )
    called = F.col("_called")
    share = F.when(
        F.col("_digits") != "", F.least(F.col("_digits").cast("double"), F.lit(100.0)) / F.lit(100.0)
    ).otherwise(F.lit(0.5))
    staged = (
        df.withColumns(
            {
                "_stated": F.upper(F.regexp_extract(reply, LABEL_PATTERN, 1)),
                "_digits": F.regexp_extract(reply, CONFIDENCE_PATTERN, 1),
            }
        )
        .withColumn("_upper", upper)
        .withColumn("_called", is_document)
    )
    return staged.withColumns(
        {
            f"{prefix}ran": called.isNotNull(),
            f"{prefix}is_document": called,
            f"{prefix}confidence": F.when(called, share).when(~called, F.lit(1.0) - share),
            f"{prefix}raw_label": F.when(called, F.lit(STUDIO_WORDS[0])).when(~called, F.lit(REAL_WORD)),
        }
    ).drop("_stated", "_digits", "_upper", "_called")


def header_seconds(header: Column) -> Column:
    """Header text as finite seconds, NULL otherwise. Python-style digit
    separators are accepted; suffixed or special numbers are not."""
    return F.when(
        header.rlike(NUMBER_PATTERN), F.regexp_replace(F.trim(header), "_", "").try_cast("double")
    )


def is_ip(address: Column) -> Column:
    return F.coalesce(address.rlike(IPV4_PATTERN) | address.rlike(IPV6_PATTERN), F.lit(False))


def ipv4_number(address: Column) -> Column:
    """Dotted quad as an integer; only for text that is a valid address."""
    parts = F.split(address, r"\.", 4)
    number = F.lit(0).cast("long")
    for i in range(4):
        number = number * 256 + F.get(parts, F.lit(i)).cast("long")
    return number


def is_loopback(address: Column) -> Column:
    return F.coalesce(
        (address.rlike(IPV4_PATTERN) & address.startswith("127."))
        | (is_ip(address) & address.rlike(r"^(0{0,4}:){1,7}:?0{0,3}1$")),
        F.lit(False),
    )


def effective_ip(peer: Column, forwarded: Column, trust_proxy: bool) -> Column:
    """Address to judge: the last forwarded hop, but only when proxies are
    trusted, the peer itself is loopback and the hop is a valid address."""
    peer = F.coalesce(peer, F.lit("0.0.0.0"))
    if not trust_proxy:
        return peer
    hops = F.filter(
        F.transform(F.split(F.coalesce(forwarded, F.lit("")), ","), lambda h: F.trim(h)),
        lambda h: h != "",
    )
    last = F.try_element_at(hops, F.lit(-1))
    return F.when(is_loopback(peer) & is_ip(last), last).otherwise(peer)


def challenge_steps(session_id: Column, pool: str, count: int, random: bool = False) -> Column:
    """Ordered subset of the comma-separated step pool.

    ``random`` draws afresh; the default orders steps by a hash of session
    and step, so a re-run of the job issues the same challenge.
    """
    steps = [s.strip() for s in pool.split(",") if s.strip()]
    k = min(count, len(steps))
    if random:
        return F.slice(F.shuffle(F.array(*[F.lit(s) for s in steps])), 1, k)
    keyed = F.array(
        *[F.struct(F.sha2(F.concat_ws("|", session_id, F.lit(s)).cast("binary"), 256).alias("k"), F.lit(s).alias("s")) for s in steps]
    )
    return F.transform(F.slice(F.array_sort(keyed), 1, k), lambda e: e["s"])

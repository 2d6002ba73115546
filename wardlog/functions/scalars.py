"""Scalar column functions: severities, times, addresses, type coercion, decisions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Severity names and their scores.
SEVERITY_SCORES = {
    "EMERGENCY": 5,
    "ALERT": 5,
    "CRITICAL": 4,
    "ERROR": 3,
    "WARNING": 2,
    "NOTICE": 1,
    "INFO": 0,
    "DEBUG": 0,
}
# Lower bounds of anomaly-score steps 1..5.
ANOMALY_CUTS = (3, 7, 13, 21, 27)
# Probability bands (name, upper bound); the last band is open.
BAND_SPECS = {
    "pipeline": (("low", 0.6), ("medium", 0.8), ("high", None)),
    "api": (("low", 0.7), ("medium", 0.85), ("high", None)),
}
LOCAL_OFFSET = "+07:00"
OVERRIDE_FLOOR = 0.99


def or_empty(col: Column) -> Column:
    return F.coalesce(col, F.lit(""))


def blank_to_null(col: Column) -> Column:
    return F.nullif(col, F.lit(""))


def severity_from_name(severity: Column) -> Column:
    """Severity name to 0..5; unknown names score 0."""
    key = F.upper(severity)
    score = F.lit(0)
    for name, value in SEVERITY_SCORES.items():
        if value:
            score = F.when(key == name, F.lit(value)).otherwise(score)
    return score


def severity_score(severity: Column) -> Column:
    """Severity name or number to 0..5. Numbers are clamped as they are, not remapped."""
    text = F.trim(or_empty(severity.cast("string")))
    return (
        F.when(text.rlike(r"^-[0-9]+$"), F.lit(0))
        .when(text.rlike(r"^\+?[0-9]+$"), F.least(F.coalesce(text.try_cast("bigint"), F.lit(5)), F.lit(5)).cast("int"))
        .otherwise(severity_from_name(text))
    )


def anomaly_to_severity(score: Column) -> Column:
    """Anomaly score to 0..5: the number of cuts it reaches; NULL and NaN give 0."""
    value = F.nanvl(score.cast("double"), F.lit(None).cast("double"))
    steps = [F.coalesce(value >= cut, F.lit(False)).cast("int") for cut in ANOMALY_CUTS]
    total = steps[0]
    for step in steps[1:]:
        total = total + step
    return total


def parse_event_time(text: Column) -> Column:
    """Log time text to a UTC timestamp; a text without zone is UTC, anything else is NULL."""
    raw = F.trim(text)
    squeezed = F.regexp_replace(F.substr(raw, F.lit(5)), " +", " ")
    asctime = F.when(
        raw.rlike(r"^[A-Za-z]{3} [A-Za-z]{3} +\d{1,2} \d{2}:\d{2}:\d{2} \d{4}$"),
        F.try_to_timestamp(squeezed, F.lit("MMM d HH:mm:ss yyyy")),
    )
    iso = F.when(
        raw.rlike(r"^\d{4}-\d{2}-\d{2}([T ]\d{2}:\d{2}(:\d{2}(\.\d{1,6})?)?(Z|[+-]\d{2}:?\d{2})?)?$"),
        raw.try_cast("timestamp"),
    )
    return F.coalesce(iso, asctime)


def to_local_time(ts: Column, fmt: str = "yyyy-MM-dd HH:mm:ss") -> Column:
    """UTC timestamp shown in the site's UTC+7 clock. Stored values stay UTC."""
    return F.date_format(F.convert_timezone(F.lit("UTC"), F.lit(LOCAL_OFFSET), ts.cast("timestamp_ntz")), fmt)


def to_local_label(ts: Column) -> Column:
    """Local time with the zone name, as shown in alerts."""
    return F.concat(to_local_time(ts), F.lit(" WIB"))


def to_local_history(ts: Column) -> Column:
    """Local time as shown in the attack history, N/A when absent."""
    return F.coalesce(F.concat(to_local_time(ts, "yyyy/MM/dd HH:mm"), F.lit(" WIB")), F.lit("N/A"))


def first_header(headers: Column, *names: str) -> Column:
    """First present header among the given spellings (an empty value counts as present)."""
    return F.coalesce(*[F.try_element_at(headers, F.lit(n)) for n in names])


def resolve_client_ip(headers: Column, client_ip: Column) -> Column:
    """Proxy headers first, then the peer address; empty values count as missing."""
    forwarded = F.trim(F.split_part(F.try_element_at(headers, F.lit("X-Forwarded-For")), F.lit(","), F.lit(1)))
    return F.coalesce(
        blank_to_null(F.try_element_at(headers, F.lit("X-Real-IP"))),
        blank_to_null(F.try_element_at(headers, F.lit("x-real-ip"))),
        blank_to_null(forwarded),
        blank_to_null(client_ip),
        F.lit("0.0.0.0"),
    )


def decode_uri(uri: Column) -> Column:
    """Percent and plus decoding; malformed escapes stay, undecodable bytes become U+FFFD."""
    coded = uri.contains("%") | uri.contains("+")
    return F.when(coded, F.url_decode(F.regexp_replace(uri, r"%(?![0-9A-Fa-f]{2})", "%25"))).otherwise(uri)


def text_or_null(col: Column) -> Column:
    return blank_to_null(col.cast("string"))


def int_or_zero(col: Column) -> Column:
    return F.coalesce(F.trim(col.cast("string")).try_cast("bigint"), col.try_cast("bigint"), F.lit(0).cast("bigint"))


def float_or_zero(col: Column) -> Column:
    return F.coalesce(col.try_cast("double"), F.lit(0.0))


def prediction_or_null(col: Column) -> Column:
    """1 for one, 0 for other numbers; other non-empty text counts as true."""
    text = blank_to_null(col.cast("string"))
    number = F.trim(text).try_cast("bigint")
    return F.when(text.isNull(), F.lit(None)).when(number.isNotNull(), (number == 1).cast("int")).otherwise(F.lit(1))


def probability_or_null(col: Column) -> Column:
    """Probability as decimal(6,5), rounded half to even."""
    return F.bround(col.try_cast("string").try_cast("decimal(38,18)"), 5).cast("decimal(6,5)")


def truncate_text(col: Column, max_length: int = 46) -> Column:
    return F.when(F.length(col) > max_length, F.concat(F.left(col, F.lit(max_length - 3)), F.lit("..."))).otherwise(col)


def format_probability(col: Column) -> Column:
    """Percent text with one decimal (rounded on the exact binary value), N/A when absent."""
    return F.coalesce(F.concat(F.format_number(col * 100.0, 1), F.lit("%")), F.lit("N/A"))


def apply_threshold(probability: Column, threshold: float = 0.5) -> Column:
    return (probability >= threshold).cast("int")


def decision(prediction: Column) -> Column:
    return F.when(prediction == 1, F.lit("ATTACK")).otherwise(F.lit("NORMAL"))


def override_hit(upload: Column, rce: Column) -> Column:
    return F.coalesce((upload == 1) | (rce == 1), F.lit(False))


def override_probability(probability: Column, hit: Column) -> Column:
    return F.when(hit, F.greatest(probability, F.lit(OVERRIDE_FLOOR))).otherwise(probability)


def severity_band(probability: Column, prediction: Column | None = None, spec: str = "pipeline") -> Column:
    """Band name of a probability; the api spec calls non-attacks 'normal'."""
    band = F.when(F.lit(False), F.lit(""))
    for name, upper in BAND_SPECS[spec]:
        band = band.when(probability < upper, F.lit(name)) if upper is not None else band.otherwise(F.lit(name))
    if spec == "api":
        return F.when(prediction == 0, F.lit("normal")).otherwise(band)
    return band


def confidence(probability: Column) -> Column:
    return F.greatest(probability, 1 - probability)

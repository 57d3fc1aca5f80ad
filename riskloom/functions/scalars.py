"""Scalar functions and projections as Column builders. Null in gives null out unless a docstring says otherwise."""

from collections.abc import Callable

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

# Fixed values.
PRODUCTS = {"P001": "消费贷", "P002": "经营贷", "P003": "信用贷"}
OTHER_PRODUCT = "其他产品"
CHANNELS = {"APP": "手机APP", "WEB": "官方网站", "WECHAT": "微信公众号", "OFFLINE": "线下网点", "PARTNER": "合作渠道"}
OTHER_CHANNEL = "其他渠道"
EDUCATION = {"高中及以下": "1", "大专": "2", "本科": "3", "硕士": "4", "博士": "5"}
PASSED, REJECTED, MANUAL = ("PASS", "PASSED", "APPROVE", "APPROVED"), ("REJECT", "REJECTED"), ("MANUAL", "MANUAL_REVIEW", "REVIEW")
LAYER_DAYS = {"ODS": (30, 180, 730), "DWD": (90, 365, 1095), "DWS": (180, 730, 1095), "ADS": (365, 1095, 1825), "ES_LOG": (7, 90, 365)}
TIERS = ("HOT", "WARM", "COLD", "ARCHIVE")
PROVINCE_SUFFIX = "(省|市|自治区|特别行政区)$"


def decode(col: Column, mapping: dict[str, str], default: str | Column) -> Column:
    """Label of a code; ``default`` for codes outside the mapping and for null."""
    out = None
    for code, label in mapping.items():
        out = (F if out is None else out).when(col == code, F.lit(label))
    return out.otherwise(default)


def age_years(birth: Column, as_of: str) -> Column:
    return F.year(F.lit(as_of).cast("date")) - F.year(birth.try_cast("date"))


def age_clamped(birth: Column, as_of: str) -> Column:
    """Full years at ``as_of`` within 18 to 65; 30 without a usable date."""
    years = F.floor(F.months_between(F.lit(as_of).cast("date"), birth.try_cast("date")) / 12).cast("int")
    return F.when(years.isNull(), 30).otherwise(F.greatest(F.lit(18), F.least(F.lit(65), years)))


def province(address: Column) -> Column:
    return F.when(F.contains(address, F.lit("市")), "直辖市").when(F.contains(address, F.lit("省")), F.substr(address, F.lit(1), F.instr(address, "省"))).otherwise(F.substring(address, 1, 3))


def city(address: Column) -> Column:
    to_city = F.instr(address, "市")
    return (
        F.when(F.contains(address, F.lit("区")), F.substr(address, to_city + 1, F.instr(address, "区") - to_city))
        .when(F.contains(address, F.lit("市")), F.substr(address, F.lit(1), to_city))
        .otherwise(F.substring(address, 1, 6))
    )


def risk_level(overdue_3m: Column, queries_1m: Column, queries_3m: Column) -> Column:
    """Counts count as 0 when null."""
    o, q1, q3 = (F.coalesce(c, F.lit(0)) for c in (overdue_3m, queries_1m, queries_3m))
    return F.when((o >= 3) | (q1 >= 5), "HIGH").when((o >= 1) | (q3 >= 10), "MEDIUM").otherwise("LOW")


def credit_score(loans: Column, overdue: Column) -> Column:
    return F.greatest(F.lit(300), F.least(F.lit(950), 750 - overdue * 30 + F.least(loans, F.lit(10)) * 5))


def risk_from_score(overdue: Column, score: Column) -> Column:
    return F.when((overdue >= 3) | (score < 500), "HIGH").when((overdue >= 1) | (score < 650), "MEDIUM").otherwise("LOW")


def grade(score: Column) -> Column:
    return F.when(score.isNull(), "UNKNOWN").when(score >= 650, "A").when(score >= 550, "B").when(score >= 500, "C").otherwise("D")


def infer_tier(income: Column, status: Column) -> Column:
    """Null income counts as 0."""
    money = F.coalesce(income, F.lit(0))
    weak = F.coalesce(status == "REJECTED", F.lit(False)) | ((money > 0) & (money < 30000))
    return F.when(weak, F.when(money < 10000, "ANOMALY").otherwise("HIGH_RISK")).when(money > 200000, "PREMIUM").when(money > 80000, "NORMAL").otherwise("HIGH_RISK")


def storage_tier(layer: Column, created: Column, as_of: str) -> Column:
    """Tier by age in days; a layer without a policy stays hot."""
    age, out = F.datediff(F.lit(as_of).cast("date"), created), None
    for name, bounds in LAYER_DAYS.items():
        tier = F.when(age <= bounds[0], TIERS[0]).when(age <= bounds[1], TIERS[1]).when(age <= bounds[2], TIERS[2]).otherwise(TIERS[3])
        out = (F if out is None else out).when(F.upper(layer) == name, tier)
    return out.otherwise(TIERS[0])


def archive_threshold(layer: Column, as_of: str) -> Column:
    """Data from before this date is archived; null without a policy."""
    out = None
    for name, bounds in LAYER_DAYS.items():
        out = (F if out is None else out).when(F.upper(layer) == name, F.date_sub(F.lit(as_of).cast("date"), bounds[2]))
    return out


def normalise_result(col: Column) -> Column:
    """One vocabulary: PASS, REJECT, MANUAL; null and anything else is OTHER."""
    word = F.upper(F.trim(col))
    return F.when(word.isin(*PASSED), "PASS").when(word.isin(*REJECTED), "REJECT").when(word.isin(*MANUAL), "MANUAL").otherwise("OTHER")


def score_label(probability: Column) -> tuple[Column, Column]:
    """Score (probability times 1000, one decimal) and label at 0.5."""
    return F.round(probability * 1000, 1), F.when(probability >= 0.5, 1).otherwise(0)


def between(x: Column, low: Column, high: Column) -> Column:
    """False for a null."""
    return F.coalesce(x.between(low, high), F.lit(False))


def in_list(x: Column, words: str) -> Column:
    """Membership in a comma-separated list, blanks around items ignored; false for null."""
    return F.coalesce(F.array_contains(F.transform(F.split(F.lit(words), ","), lambda w: F.trim(w)), x.cast("string")), F.lit(False))


def days_between(a: Column, b: Column) -> Column:
    """Absolute days; -1 where a date is missing or cannot be read."""
    return F.coalesce(F.abs(F.datediff(a.try_cast("date"), b.try_cast("date"))), F.lit(-1))


def in_province(address: Column, name: Column) -> Column:
    """The address holds the province, its suffix aside; false for null."""
    return F.coalesce(F.contains(address, F.regexp_replace(name, PROVINCE_SUFFIX, "")), F.lit(False))


def at_least(x: Column, threshold: Column) -> Column:
    """Numeric comparison of anything that reads as a number; else false."""
    return F.coalesce(x.try_cast("double") >= threshold, F.lit(False))


def mask_custom(col: Column, prefix: int, suffix: int, least: int | None = None) -> Column:
    """Stars for all but a prefix and a suffix; values shorter than ``least`` stay."""
    size, least = F.length(col), prefix + suffix + 1 if least is None else least
    tail = F.right(col, F.lit(suffix)) if suffix else F.lit("")
    return F.when(size >= least, F.concat(F.left(col, F.lit(prefix)), F.repeat(F.lit("*"), size - prefix - suffix), tail)).otherwise(col)


def mask_id_card(col: Column) -> Column:
    return mask_custom(col, 3, 4, 8)


def mask_mobile(col: Column) -> Column:
    return mask_custom(col, 3, 4, 7)


def mask_bank_card(col: Column) -> Column:
    return mask_custom(col, 4, 4, 8)


def mask_name(col: Column) -> Column:
    return mask_custom(col, 1, 0, 2)


def mask_email(col: Column) -> Column:
    at = F.instr(col, "@")
    simple = F.when(at > 2, F.concat(F.left(col, F.lit(1)), F.lit("***"), F.substr(col, at))).otherwise(col)
    return F.when(F.rlike(col, F.lit(r"^\w+@\w+\.\w+$")), F.regexp_replace(col, r"^(\w)\w*(@\w+\.\w+)$", "$1***$2")).otherwise(simple)


def mask_address(col: Column) -> Column:
    return mask_custom(col, 6, 0)


def auto_mask(col: Column) -> Column:
    """Identity numbers of 18 and 15 digits, cards, mobile numbers and addresses in free text, in this order."""
    for pattern, by in (
        (r"(?<!\d)(\d{3})\d{11}(\d{4})(?!\d)", "$1***********$2"),
        (r"(?<!\d)(\d{3})\d{9}(\d{3})(?!\d)", "$1*********$2"),
        (r"(?<!\d)(\d{4})\d{8,11}(\d{4})(?!\d)", "$1********$2"),
        (r"(?<!\d)(1\d{2})\d{4}(\d{4})(?!\d)", "$1****$2"),
        (r"(\w)\w*(@\w+\.\w+)", "$1***$2"),
    ):
        col = F.regexp_replace(col, pattern, by)
    return col


MASKS: dict[str, Callable[[Column], Column]] = {"id_card": mask_id_card, "mobile": mask_mobile, "bank_card": mask_bank_card, "name": mask_name, "email": mask_email, "address": mask_address}
_OWN_MASKS: dict[str, Callable[[Column], Column]] = {}


def register_mask(kind: str, mask: Callable[[Column], Column]) -> None:
    """Adds a mask for a new kind; the built-in kinds cannot be replaced."""
    if kind in MASKS:
        raise ValueError(f"{kind} is built in")
    _OWN_MASKS[kind] = mask


def mask_of(kind: str) -> Callable[[Column], Column]:
    return MASKS.get(kind) or _OWN_MASKS[kind]


def encrypt_field(col: Column, key: Column) -> Column:
    """AES-GCM, base64 with a version in front."""
    return F.concat(F.lit("v1:"), F.base64(F.aes_encrypt(col, key, F.lit("GCM"))))


def decrypt_field(col: Column, key: Column) -> Column:
    return F.aes_decrypt(F.unbase64(F.regexp_replace(col, "^v1:", "")), key, F.lit("GCM")).cast("string")


def is_encrypted(col: Column) -> Column:
    """Base64 of at least 29 bytes (nonce, a byte, tag), with or without the version; false for null."""
    return F.coalesce(F.length(F.try_to_binary(F.regexp_replace(col, "^v1:", ""), F.lit("base64"))) >= 29, F.lit(False))


def snapshot_hash(**fields: Column) -> Column:
    """First 16 hex digits of the SHA-256 of the fields as JSON in name order."""
    return F.substring(F.sha2(F.to_json(F.struct(*(fields[k].alias(k) for k in sorted(fields)))), 256), 1, 16)


def feature_row_key(entity: Column, kind: str, window: str) -> Column:
    return F.concat_ws("_", F.reverse(entity.cast("string")), F.lit(kind), F.lit(window))


def json_number(col: Column, key: str) -> Column:
    return F.get_json_object(col, f"$.{key}").try_cast("double")


def monthly_payment(principal: Column, months: Column, yearly_rate: float) -> Column:
    """Level payment, two decimals."""
    monthly = yearly_rate / 12
    growth = F.pow(F.lit(1 + monthly), months)
    return F.round(principal * monthly * growth / (growth - 1), 2)


def percent_text(share: Column) -> Column:
    return F.format_string("%.1f%%", share.cast("double") * 100)


def parse_timestamp(col: Column) -> Column:
    """The first 19 characters, with a blank or a T between date and time; null if unreadable."""
    head = F.substring(col, 1, 19)
    return F.coalesce(F.try_to_timestamp(head, F.lit("yyyy-MM-dd HH:mm:ss")), F.try_to_timestamp(head, F.lit("yyyy-MM-dd'T'HH:mm:ss")))


def event_id(prefix: str, col: Column) -> Column:
    return F.concat(F.lit(prefix + "_"), col.cast("string"))


def infer_layer(name: Column) -> Column:
    low = F.lower(name)
    return F.when(F.startswith(low, F.lit("ods.")), "ODS").when(F.startswith(low, F.lit("dwd.")), "DWD").when(F.startswith(low, F.lit("dws.")), "DWS").when(F.startswith(low, F.lit("ads.")), "ADS").otherwise("UNKNOWN")


def register_functions(spark: SparkSession) -> None:
    """The named functions as SQL functions, so that expression texts and SQL can call them."""
    for signature, body in (
        ("f_between(x DOUBLE, lo DOUBLE, hi DOUBLE) RETURNS BOOLEAN", "coalesce(x BETWEEN lo AND hi, false)"),
        ("f_in_list(x STRING, words STRING) RETURNS BOOLEAN", "coalesce(array_contains(transform(split(words, ','), w -> trim(w)), x), false)"),
        ("f_days_between(a STRING, b STRING) RETURNS INT", "coalesce(abs(datediff(try_cast(a AS DATE), try_cast(b AS DATE))), -1)"),
        ("f_in_province(address STRING, name STRING) RETURNS BOOLEAN", f"coalesce(contains(address, regexp_replace(name, '{PROVINCE_SUFFIX}', '')), false)"),
        ("f_at_least(x STRING, threshold DOUBLE) RETURNS BOOLEAN", "coalesce(try_cast(x AS DOUBLE) >= threshold, false)"),
    ):
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {signature} RETURN {body}")

"""The language dimension: names and the codes that translation services use."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Language, display name, codes of the three services (None: the service has none).
LANGUAGES = [
    ("SIMPLIFIED_CHINESE", "简体中文", "zh-CN", "zh-Hans", "zh-Hans"),
    ("TRADITIONAL_CHINESE", "繁体中文", "zh-TW", "zh-Hant", "zh-Hant"),
    ("ENGLISH", "英语", "en", "en", "en"),
    ("ENGLISH_US", "英语(美国)", "en", "en", "en-US"),
    ("ENGLISH_UK", "英语(英国)", "en", "en", "en-GB"),
    ("JAPANESE", "日本語", "ja", "ja", "ja"),
    ("KOREAN", "韩语", "ko", "ko", "ko"),
    ("CANTONESE", "粤语", "yue", "yue", None),
    ("THAI", "泰语", "th", "th", None),
    ("VIETNAMESE", "越南语", "vi", "vi", None),
    ("INDONESIAN", "印尼语", "id", "id", "id"),
    ("MALAY", "马来语", "ms", "ms", None),
    ("TAGALOG", "菲律宾语", "tl", "fil", None),
    ("FRENCH", "法语", "fr", "fr", "fr"),
    ("GERMAN", "德语", "de", "de", "de"),
    ("SPANISH", "西班牙语", "es", "es", "es"),
    ("SPANISH_LATAM", "西班牙语(拉丁美洲)", "es", "es", None),
    ("RUSSIAN", "俄语", "ru", "ru", "ru"),
    ("PORTUGUESE", "葡萄牙语", "pt", "pt", "pt"),
    ("PORTUGUESE_BR", "葡萄牙语(巴西)", "pt", "pt", "pt-BR"),
    ("PORTUGUESE_PT", "葡萄牙语(葡萄牙)", "pt", "pt-PT", "pt-PT"),
    ("ITALIAN", "意大利语", "it", "it", "it"),
    ("DUTCH", "荷兰语", "nl", "nl", "nl"),
    ("POLISH", "波兰语", "pl", "pl", "pl"),
    ("TURKISH", "土耳其语", "tr", "tr", "tr"),
    ("GREEK", "希腊语", "el", "el", "el"),
    ("CZECH", "捷克语", "cs", "cs", "cs"),
    ("SWEDISH", "瑞典语", "sv", "sv", "sv"),
    ("DANISH", "丹麦语", "da", "da", "da"),
    ("FINNISH", "芬兰语", "fi", "fi", "fi"),
    ("NORWEGIAN", "挪威语", "no", "nb", "nb"),
    ("HUNGARIAN", "匈牙利语", "hu", "hu", "hu"),
    ("ROMANIAN", "罗马尼亚语", "ro", "ro", "ro"),
    ("BULGARIAN", "保加利亚语", "bg", "bg", "bg"),
    ("UKRAINIAN", "乌克兰语", "uk", "uk", "uk"),
    ("ARABIC", "阿拉伯语", "ar", "ar", "ar"),
    ("HEBREW", "希伯来语", "he", "he", None),
    ("PERSIAN", "波斯语", "fa", "fa", None),
]
SERVICES = ("google", "bing", "deeplx")
FALLBACK = "SIMPLIFIED_CHINESE"


def dimension(spark: SparkSession) -> DataFrame:
    """``language, display_name, service, code``: 38 languages, a row for each service that has a code."""
    flat = [(r[0], r[1], service, code) for r in LANGUAGES for service, code in zip(SERVICES, r[2:], strict=True) if code]
    return spark.createDataFrame(flat, "language string, display_name string, service string, code string")


def code_of(language: str, service: str) -> str:
    """The service's code, its simplified Chinese one where it lacks the language, ``zh-CN`` for unknown services."""
    if service not in SERVICES:
        return "zh-CN"
    at = 2 + SERVICES.index(service)
    by_name = {r[0]: r[at] for r in LANGUAGES}
    return by_name.get(language) or by_name[FALLBACK]


def with_code(requests: DataFrame, spark: SparkSession, language: str = "language", service: str = "service") -> DataFrame:
    """``requests`` with ``code``; the dimension is a fixed table of about a hundred rows."""
    kept = F.struct(*[F.col(f"`{c}`") for c in requests.columns]).alias("row")
    table = F.broadcast(dimension(spark).select("language", "service", F.col("code").alias("known")))
    packed = requests.select(kept, F.col(language).alias("language"), F.col(service).alias("service"))
    return packed.join(table, ["language", "service"], "left").select("row.*", F.coalesce("known", fallback(F.col("service"))).alias("code"))


def fallback(service: Column) -> Column:
    known = F.lit(None).cast("string")
    for name in SERVICES:
        known = F.when(service == name, code_of(FALLBACK, name)).otherwise(known)
    return F.coalesce(known, F.lit("zh-CN"))

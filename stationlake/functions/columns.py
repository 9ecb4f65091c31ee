"""Scalar rules as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Code points kept of each text column.
TEXT_LIMITS = {
    "station_name": 255, "operator": 100, "address": 500, "city": 50, "business_hours": 100, "current_price": 20, "parking_fee": 200, "occupancy_fee": 300,
    "fast_available": 10, "fast_total": 10, "fast_power": 50, "super_available": 10, "super_total": 10, "super_power": 50,
    "slow_available": 10, "slow_total": 10, "slow_power": 50, "favorite_count": 10,
}
EARTH_KM = 6371.0


def as_column(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def text(c: Column | str) -> Column:
    """Trimmed text, '' for null; white space is Unicode's."""
    return F.coalesce(F.regexp_replace(as_column(c), r"(?U)^\s+|\s+$", ""), F.lit(""))


def is_filled(c: Column | str, kind: T.DataType) -> Column:
    """Neither null, empty, zero nor false."""
    c = as_column(c)
    if isinstance(kind, T.StringType):
        return F.coalesce(c != "", F.lit(False))
    if isinstance(kind, T.BooleanType):
        return F.coalesce(c, F.lit(False))
    if isinstance(kind, (T.ArrayType, T.MapType)):
        return F.coalesce(F.size(c) > 0, F.lit(False))
    if isinstance(kind, T.NumericType):
        return F.coalesce(c != 0, F.lit(False))
    return c.isNotNull()


def filled_count(df: DataFrame, columns: list[str] | None = None) -> Column:
    chosen = [f for f in df.schema.fields if columns is None or f.name in columns]
    return sum((is_filled(f.name, f.dataType).cast("int") for f in chosen), F.lit(0))


def normalize_name(c: Column | str) -> Column:
    """A station name without blanks and separators, its kind of station in one form, in lower case."""
    bare = F.regexp_replace(F.coalesce(as_column(c), F.lit("")), r"(?U)[\s（）()·•\-—_]+", "")
    return F.lower(F.replace(F.replace(bare, F.lit("汽车充电站"), F.lit("充电站")), F.lit("超级充电站"), F.lit("充电站")))


def search_phrase(name: Column | str, address: Column | str) -> Column:
    """The name; with the address, where the name is short or generic."""
    name, address = text(name), text(address)
    compact = F.regexp_replace(name, r"(?U)[\s（）()·•\-_]+", "")
    wide = (F.length(compact) <= 10) | name.isin("重卡充电站", "汽车充电站")
    return F.when((address != "") & wide, F.concat(name, F.lit(" "), address)).otherwise(name)


def station_key(station_id: Column | str, name: Column | str, latitude: Column | str, longitude: Column | str, prefix: str = "ROW-") -> Column:
    """The id, or a surrogate from name and place where it is blank."""
    made = F.substring(F.sha1(F.concat_ws("|", text(name), text(latitude), text(longitude))), 1, 16)
    return F.when(text(station_id) != "", text(station_id)).otherwise(F.concat(F.lit(prefix), made))


def limited_text(field: str, c: Column | str) -> Column:
    return F.left(F.coalesce(as_column(c), F.lit("")), F.lit(TEXT_LIMITS[field]))


def error_text(c: Column | str) -> Column:
    return F.left(as_column(c), F.lit(1000))


def utf8_truncate(c: Column | str, most: int) -> Column:
    """The longest beginning of at most so many UTF-8 bytes that cuts no character."""
    data = F.encode(as_column(c), "UTF-8")
    cut = F.regexp_replace(F.make_valid_utf8(F.substring(data, 1, most).cast("string")), "�+$", "")
    return F.when(F.octet_length(as_column(c)) <= most, as_column(c)).otherwise(cut)


def normalize_ts(c: Column | str, now: Column) -> Column:
    """ISO text with Z or an offset as a UTC timestamp without zone; now where it is blank. Sessions run in UTC."""
    return F.coalesce(F.try_to_timestamp(F.nullif(text(c), F.lit(""))), now).cast("timestamp_ntz")


def located(lng: Column | str = "longitude", lat: Column | str = "latitude") -> Column:
    lng, lat = as_column(lng), as_column(lat)
    return F.coalesce((lng != 0) & (lat != 0), F.lit(False))


def haversine_km(lng1, lat1, lng2, lat2) -> Column:
    lng1, lat1, lng2, lat2 = (as_column(c).cast("double") for c in (lng1, lat1, lng2, lat2))
    a = F.pow(F.sin(F.radians(lat2 - lat1) / 2), 2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(F.radians(lng2 - lng1) / 2), 2)
    return 2 * EARTH_KM * F.atan2(F.sqrt(a), F.sqrt(1 - a))


def parse_lnglat(c: Column | str) -> tuple[Column, Column]:
    parts = F.split(as_column(c), ",")
    return F.get(parts, F.lit(0)).try_cast("double"), F.get(parts, F.lit(1)).try_cast("double")


def point_in_grid(lng, lat, low_lng="min_lng", high_lng="max_lng", low_lat="min_lat", high_lat="max_lat") -> Column:
    """Closed on all sides; false for what isn't a number."""
    number = lambda c: as_column(c).try_cast("double")
    return F.coalesce(number(lng).between(number(low_lng), number(high_lng)) & number(lat).between(number(low_lat), number(high_lat)), F.lit(False))


def retry_delay(attempt: Column | str) -> Column:
    return F.least(F.lit(60.0), 5 * F.pow(F.lit(2.0), F.greatest(F.lit(0), as_column(attempt) - 1)))


def attempt_strategy(attempt: Column | str, most: Column | str) -> Column:
    return F.when(as_column(attempt) < as_column(most), "poi_id").otherwise("exact_search")


def equipment_summary() -> Column:
    """super_, fast_ and slow_ columns as one text."""
    parts = []
    for kind, label in (("super", "超充"), ("fast", "快充"), ("slow", "慢充")):
        free, total, power = (text(f"{kind}_{c}") for c in ("available", "total", "power"))
        count = F.when((free != "") | (total != ""), F.concat(free, F.lit("/"), total))
        parts.append(F.when((free != "") | (total != "") | (power != ""), F.concat_ws(" ", F.lit(label), count, F.nullif(power, F.lit("")))))
    return F.concat_ws("；", *parts)


def price_schedule_text(periods: Column | str) -> Column:
    """Price periods as one text; a missing fee beside a known one shows as -."""

    def one(p):
        total, elec, service = (text(p[c]) for c in ("total_price", "elec_fee", "service_fee"))
        dash = lambda c: F.when(c == "", "-").otherwise(c)
        fees = F.when((elec != "") | (service != ""), F.concat(F.lit("（电"), dash(elec), F.lit("+服"), dash(service), F.lit("）"))).otherwise("")
        return text(F.concat(text(p["time"]), F.lit(" "), total, fees))

    return F.array_join(F.transform(periods, one), "；")


def evaluate_detail(df: DataFrame) -> DataFrame:
    """df with score, detailed, missing: how complete each record is. Absent columns count as empty."""
    kinds = {f.name: f.dataType for f in df.schema.fields}
    has = lambda *names: sum((is_filled(n, kinds[n]).cast("int") for n in names if n in kinds), F.lit(0)) > 0
    equipment = has(*(f"{k}_{c}" for k in ("fast", "super", "slow") for c in ("available", "total", "power")))
    schedule, parking = has("fast_prices", "slow_prices"), has("parking_fee", "occupancy_fee")
    weights = [(25, has("detail_verified")), (15, has("station_name")), (15, has("address")), (10, has("business_hours")), (10, has("operator")), (10, has("current_price")), (7, equipment), (4, schedule), (2, parking), (2, has("facilities"))]
    score = sum((F.when(c, w).otherwise(0) for w, c in weights), F.lit(0))
    signals = sum((c.cast("int") for _, c in weights[3:]), F.lit(0))
    charging = F.col("station_name").rlike("充电|充换电|超充|快充|重卡站") if "station_name" in kinds else F.lit(False)
    charging = F.coalesce(charging, F.lit(False))
    missing = F.array_compact(F.array(
        F.when(~has("detail_verified"), "detail_verified"), F.when(~has("station_name"), "station_name").when(~charging, "charging_station_name"),
        F.when(~has("address"), "address"), F.when(signals < 2, "operational_fields"),
    ))
    detailed = has("detail_verified") & has("station_name") & charging & has("address") & (signals >= 2)
    return df.withColumns({"score": score, "detailed": detailed, "missing": missing})


def coverage_status() -> Column:
    """Of detailed, detail_verified and status."""
    false = F.lit(False)
    return F.when(F.coalesce("detailed", false), "详细").when(F.coalesce("detail_verified", false), "部分").when(F.col("status") == "failed", "失败").otherwise(F.coalesce("status", F.lit("待处理")))

"""Deterministic identities: SHA-256 over normalised fields."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from .text import collapse, is_blank, iso_field, strip


def _sha(text: Column) -> Column:
    return F.sha2(text, 256)


_NOT_HEX = "00" * 33  # longer than a packed hash, so that the two forms never meet


def packed(identity: Column) -> Column:
    """A SHA-256 in hex as its 32 bytes, for exchanges; any other text as itself behind a mark."""
    other = F.concat(F.unhex(F.lit(_NOT_HEX)), F.encode(identity, "utf-8"))
    return F.when(identity.rlike("^[0-9a-f]{64}\\z"), F.unhex(identity)).otherwise(other)


def unpacked(key: Column) -> Column:
    other = F.decode(F.substring(key, 34, 2**31 - 1), "utf-8")
    return F.when(F.octet_length(key) == 32, F.lower(F.hex(key))).otherwise(other)


def posting_identity(
    source_id: Column,
    source_record_id: Column,
    title: Column,
    employer: Column,
    location: Column,
    posted_date: Column,
) -> Column:
    """Source and record id when there is one, otherwise five descriptive fields."""
    by_record = F.concat_ws(":", collapse(source_id), collapse(source_record_id))
    by_fields = F.concat_ws(
        "|", collapse(source_id), collapse(title), collapse(employer), collapse(location),
        iso_field(posted_date, "date"),
    )
    return _sha(F.when(is_blank(source_record_id), by_fields).otherwise(by_record))


def apprenticeship_identity(
    source_id: Column,
    source_record_id: Column,
    trade: Column,
    organization: Column,
    location: Column,
    start: Column,
    end: Column,
) -> Column:
    by_record = F.concat_ws(":", collapse(source_id), collapse(source_record_id))
    by_fields = F.concat_ws(
        "|", collapse(source_id), collapse(trade), collapse(organization), collapse(location),
        iso_field(start, "date"), iso_field(end, "date"),
    )
    return _sha(F.when(is_blank(source_record_id), by_fields).otherwise(by_record))


def institute_identity(code: Column, name: Column, district: Column) -> Column:
    return _sha(F.concat_ws(":", code, name, district))


def trade_identity(
    code: Column, trade: Column, category: Column, intake: Column, position: Column,
    missing: str = "",
) -> Column:
    """``missing`` is the text a null field contributes: the two loaders differ in it."""
    return _sha(
        F.concat_ws(
            ":", code, trade, F.coalesce(category, F.lit(missing)),
            F.coalesce(intake, F.lit(missing)), position.cast("string"),
        )
    )


def cross_source_identity(
    title: Column, employer: Column, district: Column, sector: Column, posted: Column
) -> Column:
    """Older four-or-five field identity; the date joins only when present."""
    low = [F.lower(strip(F.coalesce(c, F.lit("")))) for c in (title, employer, district, sector)]
    return _sha(F.concat_ws("|", *low, F.nullif(strip(posted), F.lit(""))))


def job_code(source_id: Column, source_record_id: Column) -> Column:
    digest = _sha(F.concat_ws(":", source_id, source_record_id))
    return F.concat(F.lit("JOB-"), F.upper(F.substring(digest, 1, 16)))


def staged_job_identity(
    source_id: Column, source_record_id: Column, title: Column, employer: Column
) -> Column:
    return _sha(
        F.concat_ws(":", source_id, source_record_id, F.lower(strip(title)), F.lower(strip(employer)))
    )


def staging_id(source_id: Column, source_record_id: Column) -> Column:
    return _sha(F.concat_ws(":", source_id, F.coalesce(source_record_id, F.lit("None"))))


def content_hash(*columns: str) -> Column:
    """Hash of the whole raw payload, columns in sorted order, nulls kept distinct from ''."""
    ordered = [F.col(c) for c in sorted(columns)]
    return _sha(F.to_json(F.struct(*ordered), {"ignoreNullFields": "false"}))


def canonical_key(fields: dict[str, Column]) -> Column:
    """``name::value`` pairs joined by the unit separator, in the given order."""
    parts = [
        F.concat(F.lit(f"{name}::"), F.coalesce(F.lower(strip(c.cast("string"))), F.lit("")))
        for name, c in fields.items()
    ]
    return _sha(F.concat_ws("\x1f", *parts))


def demand_run_id(
    rule_version: str, district: Column, start: Column, end: Column, scope: Column
) -> Column:
    """Run id of a district window; ``scope`` lists the source and sector that were set."""
    return _sha(
        F.concat_ws(
            ":", F.lit(rule_version), F.lower(strip(district)),
            F.date_format(start, "yyyy-MM-dd"), F.date_format(end, "yyyy-MM-dd"), scope,
        )
    )


def skill_run_id(
    rule_version: str, district: str, source_id: str, start: str, end: str,
    sector: str | list[str] | None = None,
) -> Column:
    """Run id of a skill demand run; the sector joins the key only when set."""
    text = f"skill-demand:{rule_version}:{district.lower().strip()}:{source_id}:{start}:{end}"
    if sector:
        text += ":" + (sector if isinstance(sector, str) else ",".join(sorted(sector)))
    return _sha(F.lit(text))

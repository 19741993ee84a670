"""Product types by file name."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Products whose names are followed by platform, sensor, level, scene, date and area; then those with any parts before the date.
STRICT = "ETaDaily ETinst ETrF LE ETqualityClass ETaClassified CWSI_ET CWSI CWSI_LST TVDI Rn G H".split()
LOOSE = "NDVI EVI LAI SAVI FVC LST Albedo Emissivity RGB AirTemp NDWI MSI NDMI MNDWI NMDI NIRv GCI NDSI SI_T Rns Rnl RsDown RlDown RlUp VSWI TCI VCI VHI".split()
PLAIN = "RGB NDVI EVI SAVI NDWI".split()


def product_of(name: Column) -> Column:
    """The product of a file name; null for none. Strict names come first, then loose ones, then bare ones."""
    out = F.when(F.lit(False), F.lit(""))
    for p in STRICT:
        out = out.when(name.rlike(rf"^{p}_[A-Za-z0-9]+_[A-Za-z0-9]+_[A-Za-z0-9]+_\d{{4}}-\d{{2}}-\d{{2}}_"), p)
    for p in LOOSE:
        out = out.when(name.rlike(rf"^{p}_[A-Z0-9_]+_\d{{4}}-\d{{2}}-\d{{2}}"), p)
    for p in PLAIN:
        out = out.when(name.rlike(rf"^{p}\.tif$"), p)
    return out


def date_of(name: Column) -> Column:
    """The date in a file name, as yyyy-MM-dd; null for none."""
    found = F.regexp_extract(name, r"(?<!\d)(\d{4})[-_]?(\d{2})[-_]?(\d{2})(?!\d)", 0)
    return F.when(found != "", F.regexp_replace(found, r"(\d{4})[-_]?(\d{2})[-_]?(\d{2})", "$1-$2-$3"))

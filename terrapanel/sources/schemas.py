"""Schemas of the tables the library reads."""

from __future__ import annotations

from pyspark.sql import types as T

from terrapanel.functions.bins import TEMPERATURE_BINS


def _struct(spec: str) -> T.StructType:
    out = T.StructType()
    for part in spec.split(","):
        name, kind = part.strip().split(":")
        out = out.add(name, _KINDS[kind])
    return out


_KINDS = {
    "s": T.StringType(),
    "i": T.IntegerType(),
    "l": T.LongType(),
    "d": T.DoubleType(),
    "t": T.TimestampNTZType(),
}
_DAYS = ",".join(f"days_in_{b.name}:i" for b in TEMPERATURE_BINS)
_DAY_MEANS = ",".join(f"days_in_{b.name}:d" for b in TEMPERATURE_BINS)
_CROSSED = ",".join(f"days_in_{b.name}_x_canopy:d" for b in TEMPERATURE_BINS)

RASTER_CELL = _struct("source:s,period:s,band:i,row:i,col:i,value:d")
RASTER_AFFINE = _struct("source:s,x0:d,y0:d,dx:d,dy:d,height:i,width:i,nodata:d")
CUBE_HOURLY = _struct("valid_time:t,latitude:d,longitude:d,t2m:d,d2m:d")
GRIDDED_MONTH = _struct("variable:s,year:i,month:i,lat:d,lon:d,value:d")
GRID_REFERENCE = _struct("grid_row:i,grid_col:i,x_albers:d,y_albers:d,lon:d,lat:d,grid_id:s")
GRID_CITY = _struct("grid_id:s,grid_row:i,grid_col:i,lon:d,lat:d,city_id:i,city_name:s,province:s")
BOUNDARY = T.StructType(
    [
        T.StructField("ADM2_EN", T.StringType()),
        T.StructField("ring", T.ArrayType(_struct("lon:d,lat:d"))),
    ]
)
GRID_PANEL = _struct(
    "grid_id:s,elec_kwh:d,year:i,month:i,year_month:s,grid_row:i,grid_col:i,x_albers:d,y_albers:d,lon:d,lat:d,"
    f"ln_elec_kwh:d,city_id:i,city_name:s,province:s,{_DAYS},canopy_share:d,nightlight:d,population:d,"
    f"gdp_per_capita:d,prec:d,pres:d,rhu:d,wind:d,{_CROSSED}"
)
CITY_PANEL = _struct(
    f"city_name:s,year:i,month:i,elec_kwh:d,province:s,lon:d,lat:d,{_DAY_MEANS},canopy_share:d,nightlight:d,"
    f"population:d,gdp_per_capita:d,prec:d,pres:d,rhu:d,wind:d,{_CROSSED},grid_count:l,year_month:s"
)

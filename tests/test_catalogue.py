"""Registered queries against DuckDB on the smallest tables: some of every family."""

from __future__ import annotations

import pytest

from isohyet import catalogue
from tests.conftest import rows

SOME = """
abs ln mod mulc setctomiss setvals setrtoc2 muldpy mulcoslat masklonlatbox setcindexbox selname selseas seldate select delete seltimestep
selsmon sellonlatbox selindexbox add div atan2 lt ifthenelse timmean timavg timpctl yearcount monstd1 dayavg hourmax seasvar1 ymonmean ydaystd
yhourpctl yseasmin timselmean timselpctl yearmonmean tstepcount runmean runavg runpctl ydrunmean ydrunpctl consecsum consects timsort fldmean fldvar1 fldpctl
merstd gridboxavg zonrange vertmean vertint histfreq ensstd enspctl ensrkhist_time monsub ymondiv yhouradd timcor fldcor fldrms regres trend detrend subtrend
eca_fd eca_cdd eca_hwdi eca_cwfi eca_tg10p eca_r75ptot eca_hd eca_etr fdns strwin invertlat sethalo tpnhalo chlevelv setgrid enlarge settaxis shifttime
cat merge mergetime mergegrid replace collgrid splitseas splitsel info sinfo tinfo diff nmon showdate map output outputtab intntime inttime intlevel smooth9
fillmiss fillmiss2 ml2pl ml2hlx_lp ap2pl gheight sealevelpressure isosurface enscrps gencon genbil remapsum intgridtraj exprf setcode chunit selgrid fldavg ensavg
remapnn remapbil remapcon remapbic remapcon2 remaplaf expr aexpr const for sincos gridarea gridweights wct fc2gp
""".split()


@pytest.mark.parametrize("name", SOME)
def test_against_sql(spark, sf, duck, name):
    got = catalogue.queries()[name](spark, sf).toPandas()
    want = duck.sql(catalogue.oracle_sql()[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)


def test_every_sql_has_its_query():
    assert set(catalogue.oracle_sql()) <= set(catalogue.queries())


@pytest.mark.parametrize("name", ["enscrps", "ensbrs", "normal", "beta", "bandpass", "spectrum", "eof", "gp2sp", "sp2gp", "fillmiss", "isosurface", "stdatm"])
def test_runs(spark, sf, name):
    assert catalogue.queries()[name](spark, sf).count() > 0

"""Tables of constants of published formulas (fixed values)."""

#: Polynomials of sea water (fixed values, lowest power first): Bryden 1973.
BRYDEN = {
    "a": (3.6504e-4, 8.3198e-5, -5.4065e-7, 4.0274e-9),
    "b": (1.7439e-5, -2.9778e-7),
    "c": (8.9309e-7, -3.1628e-8, 2.1987e-10),
    "d": (4.1057e-9,),
    "e": (-1.6056e-10, 5.0484e-12),
}
#: UNESCO equation of state (fixed values, lowest power first).
STATE = {
    "a": (999.842594, 6.793952e-2, -9.095290e-3, 1.001685e-4, -1.120083e-6, 6.536332e-9),
    "b": (8.24493e-1, -4.0899e-3, 7.6438e-5, -8.2467e-7, 5.3875e-9),
    "c": (-5.72466e-3, 1.0227e-4, -1.6546e-6),
    "d": (4.8314e-4,),
    "e": (19652.21, 148.4206, -2.327105, 1.360477e-2, -5.155288e-5),
    "f": (54.6746, -0.603459, 1.09987e-2, -6.1670e-5),
    "g": (7.944e-2, 1.6483e-2, -5.3009e-4),
    "h": (3.239908, 1.43713e-3, 1.16092e-4, -5.77905e-7),
    "i": (2.2838e-3, -1.0981e-5, -1.6078e-6),
    "j": (1.91075e-4,),
    "k": (8.50935e-5, -6.12293e-6, 5.2787e-8),
    "m": (-9.9348e-7, 2.0816e-8, 9.1697e-10),
}

"""Count matrices in JASPAR text form. Some counts are negative, and scans must cope with them."""

TEXTS = {
    "MA0002.2_RUNX1": """>MA0002.2 RUNX1
A [ 10  12   4   1  2  2   0   0   0  8   13 ]
C [  2   2   7   1  0  8   0   0   1  2    2 ]
G [  3   1   1   0  23 1   26  26  0  0    4 ]
T [ 11  11  14  24  1  15   0   0  25 16    7 ]
""",
    "MA0003.4_TFAP2A": """>MA0003.4 TFAP2A
A [  9  16   1  22  0  26  1   2   3  4  17  9 ]
C [ 12   1  15   1  0   0  0  27  22  4   4  8 ]
G [  3   3  11   1  0   1  0   0   1  21   3  4 ]
T [  3   7   0   3  27   0 26  -2   1  -2   3  6 ]
""",
    "MA0079.5_SP1": """>MA0079.5 SP1
A [  87  167   281  4    26   398  1    422  2    30  194  135 ]
C [ 291   45     1  0     0     3  0      0  0    27   71  131 ]
G [  76  131   131  421  400    14  423    2  421  366  159  155 ]
T [  70   81    11  0     0     9  1      0  1     1    0    3 ]
""",
    "MA0108.1_TBP": """>MA0108.1 TBP
A [ 61  16  352  3  354  268  360  222  155  56  83  82 ]
C [ 145 46   0   10  0    0    3    2   44  135 147 127 ]
G [ 152 18   2   2   5    0   20   44  157  150 128 128 ]
T [ 31  309  35  374  30  121  6   121  33   48  31  52 ]
""",
    "MA0139.1_CTCF": """>MA0139.1 CTCF
A [ 87   167  281   56   8  744   40   107  851   5   333   54   12   56   104  372   82   117  402 ]
C [ 291   145  49   800  903   13  528   601  64  568   378  653  222  545   205  59   168  347  96  ]
G [ 76    414  449   21   0   65  334    25   0  378   104   52  463  185   475  291  502  269  171 ]
T [ 459   187  134   36   2   91  11    180  -1   -2    98  154  216  127   129  191  161  180  244 ]
""",
}

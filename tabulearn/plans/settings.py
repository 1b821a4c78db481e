"""Parameters shared by the registered queries and their SQL twins."""

X3 = ["l_quantity", "l_discount", "l_tax"]
X4 = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]

ROUNDS = 3
GBDT_RATE = 0.1
GRID_FOLDS = 3
GRID_DEPTHS = [1, 2]
GRID_SAMPLES = [2, 12000]

STEPS = 3
UPDATES = 5
PLANE = (4.0, -14.0, 6.0, 43.0)  # on whole numbers never zero
LOGIT_RATE = 0.01
LOGIT_DECAY = 0.1
LOGIT_C = 2.0
BATCH_SHARE = 0.4

SV_ALPHA = 0.5
SV_B = 0.05
SIGMA = 1.0
SVM_C = 0.5

COIN_START = (0.3, 0.1)
GMM_START = ([0.5, 0.5], [20.0, 100.0], [400.0, 2500.0])

SYMBOLS = ("click", "error", "purchase", "signup", "view")
# Start and transition probabilities of the three-state example.
HMM_START = [0.2, 0.4, 0.4]
HMM_TRANS = [[0.5, 0.2, 0.3], [0.3, 0.5, 0.2], [0.2, 0.3, 0.5]]
HMM_EMIT = [[0.1, 0.2, 0.3, 0.2, 0.2], [0.3, 0.1, 0.1, 0.2, 0.3], [0.2, 0.2, 0.2, 0.3, 0.1]]

WIDE = 5000

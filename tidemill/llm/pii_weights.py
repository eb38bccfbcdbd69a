"""Weights of the semi-Markov field by feature and type; made by ``pii.fit()``."""

WEIGHTS = {
    "bias": [-1.855, -2.608, -2.123, -2.789, -2.002, -1.919],
    "tokens1": [-1.409, -1.272, -2.447, -1.546, 1.072, 0.488],
    "tokens2-4": [-1.297, -1.866, -0.263, -2.779, -1.869, -1.515],
    "tokens5+": [-1.006, -0.728, -1.088, -1.272, -2.743, -1.765],
    "chars<7": [0.0, 0.0, 0.0, 0.0, 0.0, 0.0],
    "chars7-15": [-2.605, -1.362, -3.888, -1.543, -2.449, -1.846],
    "chars16-31": [-0.613, -1.716, 0.129, -2.836, -2.765, -0.322],
    "chars32+": [-0.653, -0.528, -0.733, -1.464, 1.496, -0.309],
    "digits0": [-0.292, -0.156, -0.991, -0.677, -0.048, -0.351],
    "digits<half": [-0.788, -1.535, -1.423, -2.249, -0.805, -1.347],
    "digits>half": [-0.346, -0.539, -2.823, -3.01, -0.072, 1.679],
    "alldigits": [-2.137, -1.276, -0.04, -0.9, -2.255, -3.158],
    "hex": [-0.01, -0.001, -0.075, -0.0, 1.079, 0.581],
    "at": [0.889, -0.692, -1.036, -0.7, -0.37, -0.53],
    "mail": [1.258, -0.482, -0.028, -0.002, -0.125, -0.137],
    "dots3": [4.723, 4.748, -0.024, -0.13, -0.071, -0.047],
    "quad": [-0.123, 5.191, -0.007, -0.126, -0.0, -0.0],
    "luhn": [-0.018, 0.031, 7.566, 0.527, -0.16, 0.263],
    "plus": [-0.0, -0.002, -0.095, 5.678, -0.0, -0.0],
    "parens": [-0.0, -0.001, -0.001, 4.575, -0.0, -0.0],
    "spaces": [-4.305, -1.69, -0.635, 1.106, -3.342, -2.633],
    "hyphens": [-0.691, -1.457, 0.546, 1.828, -0.178, -0.62],
    "mixed": [-1.053, -2.018, -3.608, -4.005, -0.639, -2.835],
    "entropy<2.5": [-0.435, 0.023, -0.304, -0.834, -0.643, -0.447],
    "entropy>3.2": [-0.832, -1.645, -1.81, -0.431, -0.369, -0.449],
    "n9-15": [-0.739, 0.91, -2.498, 2.854, -0.177, -0.536],
    "n12-19": [-0.816, 0.011, 0.608, 1.773, -0.666, -0.609],
    "iban": [-0.035, -0.003, -0.15, -0.0, -0.14, 2.941],
    "iban97": [-0.035, -0.003, -0.15, -0.0, -0.14, 2.941],
    "quoted": [-0.011, -0.0, -0.0, -0.0, 1.478, -0.018],
    "assigned": [1.847, -0.074, 0.613, 1.477, 2.858, 0.427],
    "edge-symbol": [0.0, 0.0, 0.0, 0.0, 0.0, 0.0],
    "glued": [-0.351, -0.418, -1.391, -2.636, -0.144, -0.485],
    "word": [0.0, 0.0, 0.0, 0.0, 0.0, 0.0],
    "before=card": [-0.005, -0.003, 2.007, -0.251, -0.009, -0.018],
    "before=email": [-0.546, -0.306, -0.018, -0.003, -0.29, -0.099],
    "before=iban": [-0.087, -0.018, -0.069, -0.005, -0.126, 1.268],
    "before=ip": [-0.037, 1.816, -0.012, -0.09, -0.0, -0.001],
    "before=other": [0.854, -0.813, -1.302, -3.595, -0.711, -0.53],
    "before=phone": [-0.004, -0.023, -0.034, 5.812, -0.008, -0.005],
    "before=secret": [-0.035, -0.001, -0.004, -0.002, 3.23, 0.037],
}

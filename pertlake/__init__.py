"""pertlake: perturbation-effect analytics as Spark DataFrame operators.

Every public function takes and returns DataFrames; the plan is declared with
the DataFrame API and optimised by Catalyst. See README.md for the layout.
"""

__version__ = "0.1.0"

"""Answer-reliability analytics as Spark DataFrame operators.

Sub-packages:

* ``sources``   - readers and writers: question sets, result runs, registries
* ``functions`` - Column functions (text, arrays, overlap scores, small linear algebra)
* ``operators`` - DataFrame operators (sampling, prompts, uncertainty, spectra, evaluation)
* ``plans``     - multi-step jobs and the registered queries with their SQL oracles
"""

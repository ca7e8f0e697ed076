"""From workbook formulas to plans: families of copied formulas, recalculation order, versions."""

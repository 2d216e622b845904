"""The operators: rules, transforms, binning, summary, the checks, findings and the review tracker."""
